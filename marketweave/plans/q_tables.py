"""Queries for projection, joins, set operations, aggregates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions import scalar as sc
from marketweave.functions.num import r, sdiv
from marketweave.operators import integrate as ig
from marketweave.operators import profile as pf
from marketweave.operators import series as s
from marketweave.plans.registry import query
from marketweave.plans.roles import BAR_AXIS, SQL_BARS, SQL_NEWS, bars, daily_orders, sql_inventory, table, table_paths, texts
from marketweave.sources.inventory import inventory

WITH = "WITH " + SQL_BARS

# Entities and the words that stand for them in the texts.
ENTITIES = {0: ("THE", "OF THE"), 1: ("AND THE", "WITH"), 2: ("DER", "UND DIE"), 3: ("LES", "DANS LE", "EL")}


def _rounded(df, digits=4, skip=()):
    from pyspark.sql import types as T

    return df.select(
        *[
            r(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# -- projection and predicates ----------------------------------------------------------------


@query(
    "derived_columns_and_filters",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'daily' AS interval_name, l_extendedprice * (1 - l_discount) AS net_price,
      CAST(l_shipdate AS DATE) AS ship_day FROM lineitem
    WHERE l_suppkey IN (1, 2, 3, 5, 8) AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""",
)
def derived_columns_and_filters(spark, sf):
    li = table(spark, sf, "lineitem")
    return (
        li.filter(F.col("l_suppkey").isin(1, 2, 3, 5, 8))
        .filter(F.col("l_shipdate").between(F.to_timestamp(F.lit("1996-01-01")), F.to_timestamp(F.lit("1998-12-31"))))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", F.lit("daily").alias("interval_name"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"), F.to_date("l_shipdate").alias("ship_day"),
        )
    )


@query("numeric_columns_only", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_columns_only(spark, sf):
    from marketweave.functions.num import numeric_columns

    o = table(spark, sf, "orders")
    return o.select(*numeric_columns(o))


@query(
    "columns_by_pattern_without_constants",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem",
)
def columns_by_pattern_without_constants(spark, sf):
    """Columns whose name ends in key or price; a constant one would be dropped by its variance."""
    from marketweave.sources.schema import columns_like

    li = table(spark, sf, "lineitem").withColumn("flat_price", F.lit(1.0))
    chosen = columns_like(li, suffixes=("key", "price"))
    return li.select(*chosen).drop(*pf.near_constant_columns(li, chosen))


@query(
    "first_existing_column_and_null_drop",
    "SELECT event_id, ts AS event_time FROM events WHERE ts IS NOT NULL AND value IS NOT NULL",
)
def first_existing_column_and_null_drop(spark, sf):
    from marketweave.sources.schema import first_existing

    e = table(spark, sf, "events").dropna(subset=["ts", "value"]).drop("no_such_column")
    return e.select("event_id", first_existing(e, ["Date", "date", "ts", "timestamp"]).alias("event_time"))


@query(
    "keyword_and_symbol_predicates",
    r"""SELECT doc_id, CAST(contains(upper(text), 'THE') OR contains(upper(text), 'DER ') AS INT) AS by_keyword,
      CAST(regexp_matches(text, '(?i)\$?\bder\b') AS INT) AS by_symbol FROM documents""",
)
def keyword_and_symbol_predicates(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", ig.contains_any(["text"], ["the", "der "]).cast("int").alias("by_keyword"), ig.mentions_symbol("text", "der").cast("int").alias("by_symbol")
    )


@query("seeded_row_sample")
def seeded_row_sample(spark, sf):
    """The same 500 rows on every run: the smallest hashes of key and seed (a sampling operator)."""
    from marketweave.sources.schema import seeded_sample

    return seeded_sample(table(spark, sf, "orders"), ["o_orderkey"], 500, seed=42)


# -- joins and set operations -----------------------------------------------------------------


@query(
    "bars_with_daily_news",
    f"""{WITH}, {SQL_NEWS} SELECT b.key, b.day, b.close, n.news_count, round(n.news_sentiment, 6) AS news_sentiment FROM bars b LEFT JOIN news n ON b.day = n.day""",
)
def bars_with_daily_news(spark, sf):
    out = ig.attach_daily(bars(spark, sf), daily_orders(spark, sf), ["day"])
    return out.select("key", "day", "close", "news_count", r("news_sentiment").alias("news_sentiment"))


@query(
    "bars_with_social_and_indicator",
    f"""{WITH}, soc AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, o_totalprice AS t FROM orders),
    a AS (SELECT day, count(*) AS post_count, avg(t) AS t_avg, sum(t) AS t_sum FROM soc GROUP BY day),
    m AS (SELECT day, avg(close) AS index_close FROM bars GROUP BY day)
    SELECT b.key, b.day, a.post_count, round(a.t_avg, 6) AS o_totalprice_avg, round(a.t_sum, 4) AS o_totalprice_sum, round(m.index_close, 7) AS index_close
    FROM bars b LEFT JOIN a ON a.day = b.day LEFT JOIN m ON m.day = b.day""",
)
def bars_with_social_and_indicator(spark, sf):
    b = bars(spark, sf)
    social = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    index = b.groupBy("day").agg(F.avg("close").alias("index_close"))
    out = ig.attach_daily(ig.attach_daily(b, ig.daily_activity(social, ["day"], ["o_totalprice"]), ["day"]), index, ["day"])
    return out.select(
        "key", "day", "post_count", r("o_totalprice_avg", 6).alias("o_totalprice_avg"), r("o_totalprice_sum", 4).alias("o_totalprice_sum"),
        r("index_close", 7).alias("index_close"),
    )


def _alias_table(spark):
    rows = [(e, a) for e, names in ENTITIES.items() for a in names]
    return spark.createDataFrame(rows, "entity int, alias string")


_SQL_GRAMS = r"""w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(upper(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents)"""
_SQL_ALIAS = "a AS (SELECT * FROM (VALUES " + ", ".join(f"({e}, '{a}')" for e, ns in ENTITIES.items() for a in ns) + ") v(entity, alias))"


@query(
    "texts_matched_to_entities",
    f"WITH {_SQL_GRAMS}, {_SQL_ALIAS} SELECT DISTINCT doc_id, CAST(entity AS INT) AS entity FROM w, a WHERE contains(t, ' ' || alias || ' ')",
)
def texts_matched_to_entities(spark, sf):
    return ig.match_entities(texts(spark, sf, "documents"), "text", ["doc_id"], _alias_table(spark))


@query(
    "texts_matched_by_substring",
    f"WITH {_SQL_ALIAS} SELECT DISTINCT doc_id, CAST(entity AS INT) AS entity FROM documents, a WHERE contains(upper(text), alias)",
)
def texts_matched_by_substring(spark, sf):
    return ig.match_entities_contains(texts(spark, sf, "documents"), ["text"], ["doc_id"], ENTITIES)


@query(
    "integrated_entity_panel",
    f"""{WITH}, {_SQL_GRAMS}, {_SQL_ALIAS}, hit AS (SELECT DISTINCT doc_id, entity FROM w, a WHERE contains(t, ' ' || alias || ' ')),
    n AS (SELECT hit.entity AS key, CAST(o.o_orderdate AS DATE) AS day, count(*) AS news_count, avg(o.o_totalprice / 100000.0) AS news_sentiment
          FROM hit JOIN orders o ON o.o_orderkey = hit.doc_id GROUP BY ALL)
    SELECT b.key, b.day, b.close, n.news_count, round(n.news_sentiment, 6) AS news_sentiment FROM bars b LEFT JOIN n ON n.key = b.key AND n.day = b.day""",
)
def integrated_entity_panel(spark, sf):
    """Texts of all entities matched in one job, aggregated per day, joined on the bars."""
    from marketweave.plans.workflows import integrate_panel

    docs = texts(spark, sf, "documents").select("doc_id", "text")
    dated = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 100000.0).alias("score")
    )
    out = integrate_panel(bars(spark, sf), docs, dated, _alias_table(spark))
    return out.select("key", "day", "close", "news_count", r("news_sentiment").alias("news_sentiment"))


@query(
    "positions_joined_by_row_id",
    """SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def positions_joined_by_row_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "news_coverage_of_bars",
    f"""{WITH}, {SQL_NEWS} SELECT b.key, count(*) AS bars, count(n.news_count) AS covered, round(count(n.news_count) / count(*) * 100, 4) AS coverage_pct
      FROM bars b LEFT JOIN news n ON n.day = b.day GROUP BY b.key""",
)
def news_coverage_of_bars(spark, sf):
    joined = ig.attach_daily(bars(spark, sf), daily_orders(spark, sf), ["day"])
    return _rounded(ig.coverage(joined, ["key"], "news_count"))


@query(
    "dates_shared_and_uncovered",
    f"""{WITH}, {SQL_NEWS}, d AS (SELECT DISTINCT day FROM bars)
    SELECT 'shared' AS kind, day FROM (SELECT day FROM d INTERSECT SELECT day FROM news) UNION ALL SELECT 'uncovered', day FROM d WHERE day NOT IN (SELECT day FROM news)""",
)
def dates_shared_and_uncovered(spark, sf):
    days, news = bars(spark, sf).select("day").distinct(), daily_orders(spark, sf)
    shared = ig.shared_dates(days, news, "day").select(F.lit("shared").alias("kind"), "day")
    return shared.unionByName(ig.uncovered(days, news, ["day"]).select(F.lit("uncovered").alias("kind"), "day"))


@query(
    "union_of_sources",
    """SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS event_type FROM orders
    UNION ALL SELECT 'events', event_id, value, event_type FROM events""",
)
def union_of_sources(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("id"), F.col("value").alias("amount"), "event_type")
    return ig.union_sources([a, b])


@query(
    "duplicate_row_counts",
    """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang), h AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT 'documents' AS dataset, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g
    UNION ALL SELECT 'lineitem', CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT) FROM h
    UNION ALL SELECT 'events', (SELECT count(*) + count(*) FILTER (event_id % 5 = 0) + count(*) FILTER (event_id % 7 = 0) FROM events), (SELECT count(*) FILTER (event_id % 5 = 0) FROM events)""",
)
def duplicate_row_counts(spark, sf):
    """The events hold whole rows again, and rows that differ by a microsecond only."""
    e = table(spark, sf, "events")
    late = e.filter("event_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL '0.000001' SECOND"))
    c = pf.duplicate_rows(e.unionByName(e.filter("event_id % 5 = 0")).unionByName(late)).withColumn("dataset", F.lit("events"))
    a = pf.duplicate_rows(table(spark, sf, "documents"), ["text", "lang"]).withColumn("dataset", F.lit("documents"))
    b = pf.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("dataset", F.lit("lineitem"))
    return a.unionByName(b).unionByName(c).select("dataset", "rows", "duplicates")


@query(
    "first_of_duplicate_rows",
    "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang",
)
def first_of_duplicate_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return pf.drop_duplicate_rows(d, ["text", "lang"], ["doc_id"]).select("doc_id", "lang")


# -- aggregates -------------------------------------------------------------------------------


@query(
    "daily_sentiment_statistics",
    """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, (o_totalprice - 250000.0) / 250000.0 AS s FROM orders)
    SELECT day, count(o_orderpriority) AS article_count, round(avg(s), 4) AS sentiment_avg, round(stddev_samp(s), 4) AS sentiment_std,
      round(min(s), 4) AS sentiment_min, round(max(s), 4) AS sentiment_max FROM x GROUP BY day""",
)
def daily_sentiment_statistics(spark, sf):
    o = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("day"), "o_orderpriority", ((F.col("o_totalprice") - 250000.0) / 250000.0).alias("s")
    )
    return ig.daily_sentiment(o, ["day"], "s", "o_orderpriority")


@query(
    "daily_activity_statistics",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS post_count, round(avg(value), 6) AS value_avg, round(sum(value), 4) AS value_sum FROM events GROUP BY 1""",
)
def daily_activity_statistics(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    return ig.daily_activity(e, ["day"], ["value"]).select("day", "post_count", r("value_avg").alias("value_avg"), r("value_sum", 4).alias("value_sum"))


@query(
    "generic_daily_aggregate",
    """SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, count(*) AS row_count, round(avg(l_quantity), 6) AS l_quantity_avg,
      round(avg(l_extendedprice), 6) AS l_extendedprice_avg, round(avg(l_discount), 6) AS l_discount_avg, round(avg(l_tax), 6) AS l_tax_avg FROM lineitem GROUP BY 1, 2""",
)
def generic_daily_aggregate(spark, sf):
    li = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = ig.daily_any(li, ["day", "l_suppkey"])
    return out.select(
        "day", "l_suppkey", "row_count", r("l_quantity_avg").alias("l_quantity_avg"), r("l_extendedprice_avg", 6).alias("l_extendedprice_avg"),
        r("l_discount_avg").alias("l_discount_avg"), r("l_tax_avg").alias("l_tax_avg"),
    )


@query(
    "group_means_and_sizes",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 3) AS mean_price, round(stddev_samp(l_extendedprice), 3) AS std_price FROM lineitem GROUP BY 1, 2""",
)
def group_means_and_sizes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 3).alias("mean_price"), r(F.stddev_samp("l_extendedprice"), 3).alias("std_price")
    )


@query(
    "monthly_return_pivot",
    f"""{WITH}, x AS (SELECT year(day) AS y, month(day) AS m, close / lag(close) OVER (PARTITION BY key ORDER BY day) - 1 AS ret FROM bars)
    SELECT y AS year, {', '.join(f'round(avg(ret) FILTER (m = {m}), 6) AS m{m}' for m in range(1, 13))} FROM x GROUP BY y""",
)
def monthly_return_pivot(spark, sf):
    x = s.returns(bars(spark, sf), BAR_AXIS).select(F.year("day").alias("year"), F.month("day").alias("m"), "daily_return")
    wide = x.groupBy("year").pivot("m", list(range(1, 13))).agg(F.avg("daily_return"))
    return wide.select("year", *[r(F.col(f"`{m}`")).alias(f"m{m}") for m in range(1, 13)])


_DIST = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "distinct_counts_per_column",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio FROM orders" for c in _DIST),
)
def distinct_counts_per_column(spark, sf):
    return _rounded(pf.distinct_profile(table(spark, sf, "orders"), _DIST), 6)


@query("top_values", "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(spark, sf):
    return pf.value_counts(table(spark, sf, "documents"), "source", 10)


@query(
    "category_shares_and_balance",
    """WITH v AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS top FROM (SELECT n FROM v ORDER BY n DESC, l_partkey LIMIT 5))
    SELECT round(any_value(t.top) / sum(n) * 100, 6) AS top_share_pct, count(*) AS categories, round(stddev_samp(n) / avg(n), 6) AS balance,
     (SELECT l_partkey FROM v ORDER BY n DESC, l_partkey LIMIT 1) AS most_common FROM v, t""",
)
def category_shares_and_balance(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey")
    one = pf.top_share(li, "l_partkey").crossJoin(pf.category_balance(li, "l_partkey"))
    return _rounded(one, 6).withColumn("most_common", F.lit(pf.most_common(li, "l_partkey")))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _sql_numeric(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) AS variance,
      min({c}) AS min, max({c}) AS max, round(max({c}) - min({c}), 4) AS range, round(quantile_cont({c}, 0.5), 4) AS median, round(skewness({c}), 4) AS skewness,
      round(kurtosis({c}), 4) AS kurtosis, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, 0::BIGINT AS infinite,
      round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
      count(*) FILTER ({c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)
                    OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)) AS outliers,
      round(count(*) FILTER ({c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)
                    OR {c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)) / count({c}) * 100, 4) AS outlier_pct FROM lineitem"""


@query("numeric_profile", " UNION ALL ".join(_sql_numeric(c) for c in _NUM))
def numeric_profile(spark, sf):
    out = pf.numeric_profile(table(spark, sf, "lineitem"), _NUM)
    return _rounded(out.withColumn("variance", r("variance", 2)), 4, skip=("variance", "min", "max"))


@query(
    "numeric_profile_with_gaps",
    """SELECT count(v) AS "count", round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, max(v) AS max, count(*) FILTER (v < 0) AS negatives
    FROM (SELECT CASE WHEN event_id % 10 <> 0 AND event_id % 11 <> 0 THEN value - 10 END AS v FROM events)""",
)
def numeric_profile_with_gaps(spark, sf):
    """A tenth of the values is NaN, an eleventh null."""
    v = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 11 != 0, F.col("value") - 10)
    out = pf.numeric_profile(table(spark, sf, "events").select(v.alias("v")), ["v"])
    return out.select("count", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"), "max", "negatives")


_STR = ("text", "lang", "source")


@query(
    "string_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT trim({c}, ' ')) AS "distinct", round(avg(length(trim({c}, ' '))), 4) AS avg_length,
        min(length(trim({c}, ' '))) AS min_length, max(length(trim({c}, ' '))) AS max_length, count(*) FILTER (trim({c}, ' ') = '') AS empty,
        count(*) FILTER (trim({c}, ' ') = '' AND length({c}) > 0) AS whitespace_only FROM documents""" for c in _STR
    ),
)
def string_profile(spark, sf):
    return _rounded(pf.string_profile(table(spark, sf, "documents"), _STR))


@query(
    "datetime_profile",
    """SELECT 'ts' AS "column", min(ts) AS min, max(ts) AS max, CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) AS range_days,
     count(*) FILTER (isodow(ts) >= 6) AS weekend, count(*) FILTER (isodow(ts) < 6) AS weekday, count(*) FILTER (ts IS NULL) AS invalid FROM events""",
)
def datetime_profile(spark, sf):
    return pf.datetime_profile(table(spark, sf, "events"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation, CAST(abs(corr({a}, {b})) > 0.5 AS INT) AS is_strong FROM lineitem" for a, b in _PAIRS
    ),
)
def correlation_matrix(spark, sf):
    pairs = pf.correlation_pairs(table(spark, sf, "lineitem"), _CORR)
    return pairs.select("a", "b", r("correlation").alias("correlation"), (F.abs("correlation") > 0.5).cast("int").alias("is_strong"))


@query(
    "strongest_correlation_pairs",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(correlation) > 0.002",
)
def strongest_correlation_pairs(spark, sf):
    return _rounded(pf.strong_pairs(pf.correlation_pairs(table(spark, sf, "lineitem"), _CORR), 0.002), 6)


_INT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "interaction_strengths",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation,
        CASE WHEN abs(corr({a}, {b})) > 0.7 THEN 'strong' WHEN abs(corr({a}, {b})) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem"""
        for i, a in enumerate(_INT) for b in _INT[i + 1 :]
    ),
)
def interaction_strengths(spark, sf):
    return _rounded(pf.interactions(table(spark, sf, "lineitem")), 6)


@query(
    "target_correlations",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS correlation, round(abs(corr({c}, l_extendedprice)), 6) AS strength FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey")
    ) + ") ORDER BY strength DESC, feature LIMIT 3",
)
def target_correlations(spark, sf):
    cols = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey")
    return _rounded(pf.target_correlation(table(spark, sf, "lineitem"), "l_extendedprice", cols, 3), 6)


_SQL_NATION_DAY = """nd AS (SELECT s_nationkey AS n, date_trunc('month', l_shipdate) AS day, avg(l_extendedprice / l_quantity) AS p
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(
    "correlation_network",
    f"""WITH {_SQL_NATION_DAY} SELECT x.n AS a, y.n AS b, round(corr(x.p, y.p), 6) AS correlation, count(*) AS days
      FROM nd x JOIN nd y ON x.day = y.day AND x.n < y.n GROUP BY 1, 2 HAVING abs(corr(x.p, y.p)) > 0.2""",
)
def correlation_network(spark, sf):
    """Monthly mean price per nation; the 25 nations are a fixed dimension."""
    li = table(spark, sf, "lineitem").select("l_suppkey", F.date_trunc("month", "l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    # pre-aggregate per supplier and month before meeting the supplier table
    per_supp = li.groupBy("l_suppkey", "day").agg(F.sum("p").alias("sp"), F.count("p").alias("np"))
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n"))
    nd = per_supp.join(sup, "l_suppkey").groupBy("n", "day").agg(sdiv(F.sum("sp"), F.sum("np")).alias("p"))
    return _rounded(pf.key_correlations(nd, "n", "day", "p", list(range(25)), 0.2), 6)


@query(
    "volume_profile",
    f"""{WITH}, e AS (SELECT key, min(low) AS lo, max(high) AS hi FROM bars GROUP BY key),
    x AS (SELECT b.key, CAST(floor((close - lo) / nullif(hi - lo, 0) * 49) AS INT) AS bin, volume FROM bars b JOIN e ON b.key = e.key)
    SELECT key, bin, sum(volume) AS volume, count(*) AS bars FROM x WHERE bin < 49 GROUP BY 1, 2""",
)
def volume_profile(spark, sf):
    return pf.volume_profile(bars(spark, sf))


@query(
    "return_histogram",
    f"""{WITH}, x AS (SELECT close / lag(close) OVER (PARTITION BY key ORDER BY day) - 1 AS v FROM bars), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
    SELECT CAST(least(floor((v - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n FROM x, e WHERE v IS NOT NULL GROUP BY 1""",
)
def return_histogram(spark, sf):
    return pf.histogram(s.returns(bars(spark, sf), BAR_AXIS), "daily_return", 50)


@query(
    "return_normal_fit",
    f"""{WITH}, x AS (SELECT key, ln(close / lag(close) OVER (PARTITION BY key ORDER BY day)) AS v FROM bars)
    SELECT key, round(avg(v), 8) AS mu, round(stddev_pop(v), 8) AS sigma, count(v) AS n FROM x GROUP BY key""",
)
def return_normal_fit(spark, sf):
    x = s.returns(bars(spark, sf), BAR_AXIS)
    return x.groupBy("key").agg(r(F.avg("log_return"), 8).alias("mu"), r(F.stddev_pop("log_return"), 8).alias("sigma"), F.count("log_return").alias("n"))


@query(
    "null_counts_per_column",
    f"""WITH x AS (SELECT b.doc_id, l.quality, l.toxic FROM documents b LEFT JOIN labels l ON b.doc_id = l.doc_id) """
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*) * 100, 6) AS null_pct FROM x" for c in ("doc_id", "quality", "toxic")),
)
def null_counts_per_column(spark, sf):
    return _rounded(pf.null_profile(labelled(spark, sf)), 6)


def labelled(spark, sf):
    """Documents with their labels; most documents have none, so the label columns hold nulls."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")


@query("dataset_inventory", sql_inventory())
def dataset_inventory(spark, sf):
    return inventory(spark, table_paths(sf)).drop("scanned_columns")


@query(
    "dataset_summary",
    f"""WITH x AS ({sql_inventory()}) SELECT count(*) AS datasets, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum("columns") AS BIGINT) AS "columns", round(avg(missing_pct), 9) AS avg_missing_pct,
      max({{'n': rows, 'd': dataset}}).d AS largest FROM x""",
)
def dataset_summary(spark, sf):
    return pf.summary_of(inventory(spark, table_paths(sf))).withColumn("avg_missing_pct", r("avg_missing_pct", 9))


@query(
    "confusion_counts",
    "SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2",
)
def confusion_counts(spark, sf):
    from marketweave.operators.evaluate import confusion

    return confusion(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "missing_row_summary",
    """WITH x AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT count(*) AS rows, count(*) * 3 AS cells, CAST(sum((quality IS NULL)::INT + (toxic IS NULL)::INT) AS BIGINT) AS missing_cells,
      count(*) FILTER (quality IS NULL OR toxic IS NULL) AS rows_with_missing, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS complete_rows FROM x""",
)
def missing_row_summary(spark, sf):
    return pf.missing_rows(labelled(spark, sf))


@query(
    "missing_patterns",
    """WITH x AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT (doc_id IS NULL)::INT::VARCHAR || (quality IS NULL)::INT::VARCHAR || (toxic IS NULL)::INT::VARCHAR AS pattern, count(*) AS n FROM x GROUP BY 1""",
)
def missing_patterns(spark, sf):
    return pf.missing_patterns(labelled(spark, sf))


@query(
    "missing_correlations",
    """WITH x AS (SELECT (l.quality IS NULL)::INT AS quality, (l.toxic IS NULL)::INT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT 'quality' AS a, 'toxic' AS b, round(corr(quality, toxic), 6) AS correlation FROM x""",
)
def missing_correlations(spark, sf):
    return _rounded(pf.missing_correlation(labelled(spark, sf).select("quality", "toxic")), 6)


@query("full_table_profile")
def full_table_profile(spark, sf):
    return pf.full_profile(table(spark, sf, "orders"))


# -- scalar features --------------------------------------------------------------------------


@query(
    "calendar_features",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS dayofweek, CAST(dayofyear(ts) AS INT) AS dayofyear,
      CAST(weekofyear(ts) AS INT) AS week, CAST(quarter(ts) AS INT) AS quarter, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS minute, CAST(second(ts) AS INT) AS second,
      CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(day(ts) = 1 AS INT) AS is_month_start, CAST(CAST(ts AS DATE) = last_day(ts) AS INT) AS is_month_end,
      CAST(CAST(ts AS DATE) = date_trunc('quarter', ts) AS INT) AS is_quarter_start, CAST(CAST(ts AS DATE) = CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS INT) AS is_quarter_end,
      CAST(dayofyear(ts) = 1 AS INT) AS is_year_start, CAST(month(ts) = 12 AND day(ts) = 31 AS INT) AS is_year_end FROM events""",
)
def calendar_features(spark, sf):
    parts = sc.calendar_features(F.col("ts"))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


_CYC = {"month": ("month(o_orderdate)", 12), "day": ("day(o_orderdate)", 30), "dayofweek": ("(isodow(o_orderdate) - 1)", 7), "dayofyear": ("dayofyear(o_orderdate)", 365), "hour": ("hour(o_orderdate)", 24)}


@query(
    "cyclical_and_seasonal_features",
    "SELECT o_orderkey, " + ", ".join(f"round({f}({e} * (2 * pi() / {p})), 6) AS {n}_{f}" for n, (e, p) in _CYC.items() for f in ("sin", "cos"))
    + """, CAST(floor((month(o_orderdate) % 12 + 3) / 3) AS INT) AS season, CAST(month(o_orderdate) * 100 + day(o_orderdate) IN (101, 704, 1225) AS INT) AS is_holiday,
    CAST(isodow(o_orderdate) < 6 AS INT) AS is_business_day FROM orders""",
)
def cyclical_and_seasonal_features(spark, sf):
    c = F.col("o_orderdate")
    cyc = {n: F.round(x, 6) + 0.0 for n, x in sc.cyclical_features(c).items()}
    return table(spark, sf, "orders").select("o_orderkey", *[x.alias(n) for n, x in {**cyc, **sc.seasonal_features(c)}.items()])


@query(
    "vote_balance_and_activity",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, round(coalesce((up - down) / nullif(up + down, 0), 0), 6) AS vote_sentiment, round(n / (SELECT max(n) FROM c), 6) AS n_normalized,
      round((up - down) / ((SELECT max(abs(up - down)) FROM c) + 1), 6) AS score_normalized FROM c""",
)
def vote_balance_and_activity(spark, sf):
    e = table(spark, sf, "events")
    c = e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"), F.count(F.lit(1)).alias("n")
    ).withColumn("score", F.col("up") - F.col("down"))
    peak = c.agg((F.max(F.abs("score")) + 1).alias("__peak"))
    # one row: the broadcast side is a single aggregate
    out = ig.normalised_activity(c, "n").crossJoin(F.broadcast(peak))
    return out.select(
        "user_id", r(sc.vote_balance(F.col("up"), F.col("down"))).alias("vote_sentiment"), r("n_normalized").alias("n_normalized"),
        r(sdiv("score", "__peak")).alias("score_normalized"),
    )


@query(
    "interaction_features",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS l_quantity_x_l_extendedprice, round(l_quantity / nullif(l_extendedprice, 0), 8) AS l_quantity_div_l_extendedprice,
      round(l_quantity * l_discount, 4) AS l_quantity_x_l_discount, round(l_quantity / nullif(l_discount, 0), 4) AS l_quantity_div_l_discount,
      round(l_extendedprice * l_discount, 4) AS l_extendedprice_x_l_discount, round(l_extendedprice / nullif(l_discount, 0), 3) AS l_extendedprice_div_l_discount FROM lineitem""",
)
def interaction_features(spark, sf):
    feats = sc.interactions(["l_quantity", "l_extendedprice", "l_discount"])
    digits = {"l_quantity_x_l_extendedprice": 2, "l_quantity_div_l_extendedprice": 8, "l_extendedprice_div_l_discount": 3}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[r(c, digits.get(n, 4)).alias(n) for n, c in feats.items()])


@query(
    "statistical_transforms",
    """WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd, min(value) AS mn FROM events)
    SELECT event_id, round((value - mu) / nullif(sd, 0), 6) AS value_zscore, round(CASE WHEN mn > 0 THEN ln(value) END, 6) AS value_log, round(CASE WHEN mn >= 0 THEN sqrt(value) END, 6) AS value_sqrt,
      round(ln(value + 1e-8), 6) AS value_log_shift FROM events, s""",
)
def statistical_transforms(spark, sf):
    from marketweave.operators.features import statistical_features

    out = statistical_features(table(spark, sf, "events"), ["value"])
    return out.select("event_id", *[r(c).alias(c) for c in ("value_zscore", "value_log", "value_sqrt")], r(F.ln(F.col("value") + 1e-8)).alias("value_log_shift"))


@query(
    "category_codes",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM orders",
)
def category_codes(spark, sf):
    from marketweave.operators.features import encode_labels

    return encode_labels(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")
