"""Queries for quality scores, typing, missing values, repair and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions.num import r
from marketweave.operators import quality as ql
from marketweave.plans.q_tables import labelled
from marketweave.plans.registry import query
from marketweave.plans.roles import BAR_AXIS, SQL_BARS, TABLES, TICK_AXIS, bars, daily_orders, sql_inventory, table, table_paths
from marketweave.sources.inventory import inventory

_LAB = "x AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    "dataset_quality_scores",
    """WITH x AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT count(*) AS n, count(*) * 7 - count(doc_id) - count(text) - count(lang) - count(source) - count(n_chars) - count(quality) - count(toxic) AS mc FROM x),
    g AS (SELECT sum(c - 1) AS dup FROM (SELECT doc_id, text, lang, source, n_chars, quality, toxic, count(*) AS c FROM x GROUP BY ALL))
    SELECT 'documents' AS dataset, n AS rows, mc AS missing_cells, CAST(dup AS BIGINT) AS duplicates, 0::BIGINT AS mixed_columns, round(mc / (n * 7) * 100, 6) AS null_pct, round(dup / n * 100, 6) AS duplicate_pct,
      CAST(greatest(0, round(100 - least(mc / (n * 7) * 200, 40) - least(dup / n * 100, 20))) AS INT) AS quality_score, CAST(greatest(0, floor(100 - least(mc / (n * 7) * 100, 40) - least(dup / n * 100, 20))) AS INT) AS simple_score FROM m, g""",
)
def dataset_quality_scores(spark, sf):
    """All columns of the documents with their labels; a duplicate repeats the whole row."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    out = ql.quality_scores(d, "documents")
    return out.select(*[r(c).alias(c) if c in ("null_pct", "duplicate_pct") else F.col(c) for c in out.columns])


def _strings(spark, sf):
    """Values of several kinds as text: numbers, dates, flags, a mixture, prose."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("whole"),
        F.format_string("%.2f", "o_totalprice").alias("money"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "Yes").otherwise("no").alias("yes_no"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("mixed"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "mixed_type_columns",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS k FROM orders), b AS (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_custkey IN (0, 1)) AS b FROM orders), s AS (SELECT count(*) FILTER (lower(o_orderstatus) IN ('t', 'f', 'y', 'n')) AS f FROM orders)
    SELECT 'whole' AS "column", n AS "count", 1.0 AS numeric_share, round((SELECT count(*) FROM orders WHERE o_orderkey IN (0, 1)) / n, 6) AS boolean_share, 0 AS is_mixed FROM n
    UNION ALL SELECT 'money', n, 1.0, 0.0, 0 FROM n UNION ALL SELECT 'day_text', n, 0.0, 0.0, 0 FROM n UNION ALL SELECT 'yes_no', n, 0.0, 1.0, 0 FROM n
    UNION ALL SELECT 'mixed', n, round(k / n, 6), round(b / n, 6), 1 FROM n, b UNION ALL SELECT 'status', n, 0.0, round(f / n, 6), 0 FROM n, s""",
)
def mixed_type_columns(spark, sf):
    out = ql.mixed_type_columns(_strings(spark, sf))
    return out.select("column", "count", r("numeric_share").alias("numeric_share"), r("boolean_share").alias("boolean_share"), "is_mixed")


@query(
    "inferred_column_types",
    """SELECT "column", detected_type, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('whole', 'integer', 1.0), ('money', 'float', 1.0), ('day_text', 'datetime', 1.0), ('yes_no', 'boolean', 1.0), ('status', 'categorical', 0.9)) v("column", detected_type, confidence)""",
)
def inferred_column_types(spark, sf):
    return ql.type_scores(_strings(spark, sf).drop("mixed")).select("column", "detected_type", "confidence")


@query(
    "automatic_type_conversion",
    "SELECT o_orderkey AS whole, round(o_totalprice, 2) AS money, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day_text, o_orderkey % 2 = 0 AS yes_no, o_orderstatus AS status FROM orders",
)
def automatic_type_conversion(spark, sf):
    return ql.convert_automatically(_strings(spark, sf).drop("mixed"))


@query(
    "manual_type_conversion",
    "SELECT o_orderkey AS whole, round(o_totalprice, 2) AS money, CAST(o_orderdate AS DATE)::VARCHAR AS day_text FROM orders",
)
def manual_type_conversion(spark, sf):
    df = _strings(spark, sf).select("whole", "money", "day_text")
    return ql.convert(df, {"whole": "integer", "money": "float", "day_text": "text"})


@query("column_type_advice")
def column_type_advice(spark, sf):
    return ql.type_advice(_strings(spark, sf))


@query(
    "quality_recommendations",
    f"""WITH {_LAB}, n AS (SELECT count(*) AS n, count(*) - count(quality) AS q FROM x) SELECT c AS subject, CASE WHEN q / n > 0.5 THEN 'consider removal' ELSE 'consider imputation' END AS advice
      FROM n, (VALUES ('quality'), ('toxic')) v(c) WHERE q / n > 0.2""",
)
def quality_recommendations(spark, sf):
    return ql.recommendations(labelled(spark, sf))


@query(
    "missing_value_advice",
    f"""WITH {_LAB}, n AS (SELECT count(*) AS n, count(*) - count(quality) AS q FROM x) SELECT c AS "column", CASE WHEN c = 'doc_id' THEN 0 ELSE q END AS nulls, round(CASE WHEN c = 'doc_id' THEN 0 ELSE q / n * 100 END, 6) AS null_pct,
      CASE WHEN c = 'doc_id' THEN NULL WHEN q / n > 0.5 THEN 'remove column' WHEN q / n > 0.2 THEN 'impute with care' WHEN q / n > 0.05 THEN 'impute' WHEN q > 0 THEN 'few gaps' END AS advice FROM n, (VALUES ('doc_id'), ('quality'), ('toxic')) v(c)""",
)
def missing_value_advice(spark, sf):
    return ql.missing_advice(labelled(spark, sf)).withColumn("null_pct", r("null_pct"))


@query(
    "imputed_by_median",
    f"WITH {_LAB}, m AS (SELECT median(quality) AS q, median(toxic) AS t, median(doc_id) AS d FROM x) SELECT CAST(coalesce(doc_id, d) AS DOUBLE) AS doc_id, CAST(coalesce(quality, q) AS DOUBLE) AS quality, CAST(coalesce(toxic, t) AS DOUBLE) AS toxic FROM x, m",
)
def imputed_by_median(spark, sf):
    return ql.impute(labelled(spark, sf))


@query(
    "imputed_by_mean_and_zero",
    f"WITH {_LAB}, m AS (SELECT avg(quality) AS q FROM x) SELECT doc_id, round(coalesce(quality, q), 9) AS quality, CAST(coalesce(toxic, 0) AS DOUBLE) AS toxic FROM x, m",
)
def imputed_by_mean_and_zero(spark, sf):
    x = labelled(spark, sf)
    mean = ql.impute(x.select(F.col("doc_id").cast("string").alias("d"), "quality", "toxic"), "mean").select(F.col("d").cast("long").alias("doc_id"), r("quality", 9).alias("quality"))
    zero = ql.impute(x.select(F.col("doc_id").cast("string").alias("d"), "toxic"), "zero").select(F.col("d").cast("long").alias("doc_id"), "toxic")
    return mean.join(zero, "doc_id")


@query("imputation_comparison")
def imputation_comparison(spark, sf):
    x = labelled(spark, sf)
    return ql.imputation_report(x, ql.impute(x), ["quality", "toxic"])


@query(
    "imputed_series",
    """WITH x AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v, CASE WHEN event_type = 'purchase' THEN ts END AS t FROM events), m AS (SELECT median(v) AS m FROM x)
    SELECT event_id, coalesce(v, m) AS v, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
      first_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM x, m""",
)
def imputed_series(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("t")
    )
    return ql.impute(e, axis=TICK_AXIS).select("event_id", "v", "t")


@query(
    "plausibility_audit",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem), t AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem)
    SELECT 'l_extendedprice' AS "column", count(*) FILTER (l_extendedprice < a - 5 * (b - a) OR l_extendedprice > b + 5 * (b - a)) AS implausible, 0::BIGINT AS infinite FROM lineitem, q
    UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity < a - 5 * (b - a) OR l_quantity > b + 5 * (b - a)), 0::BIGINT FROM lineitem, t
    UNION ALL SELECT 'price_ratio', count(*) FILTER (l_extendedprice / l_quantity / 100 > 1000), 0::BIGINT FROM lineitem""",
)
def plausibility_audit(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price_ratio"))
    return ql.plausibility(li).select("column", "implausible", "infinite")


@query(
    "repaired_columns",
    """WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, value FROM events), q AS (SELECT median(v) AS m, quantile_cont(v, 0.99) AS p FROM x)
    SELECT event_id, round(greatest(CASE WHEN coalesce(v, m) > 50 THEN p ELSE coalesce(v, m) END, 1.0), 9) AS v, value AS value_text FROM x, q""",
)
def repaired_columns(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_type") == "error", float("inf")).otherwise(F.col("value")).alias("v"),
        F.col("value").cast("string").alias("value_text"),
    )
    out = ql.repair(e, floors={"v": 1.0}, ceilings={"v": 50.0}, numeric_text=["value_text"])
    return out.select(F.col("event_id").cast("long").alias("event_id"), r("v", 9).alias("v"), "value_text")


@query(
    "leakage_audit",
    """SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS correlation, 0 AS suspicious_name, 0 AS equals_target FROM lineitem
    UNION ALL SELECT 'next_price', round(corr(l_extendedprice * 2, l_extendedprice), 6), 1, 1 FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 6), 0, 0 FROM lineitem""",
)
def leakage_audit(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("next_price", F.col("l_extendedprice") * 2)
    return ql.leakage_audit(li, "l_extendedprice", ["l_quantity", "next_price", "l_tax"]).withColumn("correlation", r("correlation"))


@query(
    "constraint_violations",
    f"""WITH {SQL_BARS}, s AS (SELECT count(*) FILTER (NOT (o_totalprice > 0)) AS v, count(*) - count(DISTINCT o_orderkey) AS d FROM orders)
    SELECT 'high_not_below_low' AS rule, count(*) FILTER (NOT high >= low) AS violations FROM bars UNION ALL SELECT 'close_in_range', count(*) FILTER (NOT (close BETWEEN low AND high)) FROM bars
    UNION ALL SELECT 'volume_small', count(*) FILTER (NOT (volume <= 50)) FROM bars UNION ALL SELECT 'unique_key', 0::BIGINT""",
)
def constraint_violations(spark, sf):
    b = bars(spark, sf)
    rules = {"high_not_below_low": F.col("high") >= F.col("low"), "close_in_range": F.col("close").between(F.col("low"), F.col("high")), "volume_small": F.col("volume") <= 50}
    return ql.constraint_violations(b, rules, ["key", "day"])


@query("orphan_keys", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_keys(spark, sf):
    parent = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return ql.orphans(table(spark, sf, "lineitem"), parent, ["l_orderkey"])


@query(
    "integration_validation",
    f"""WITH {SQL_BARS}, n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS news_count FROM orders GROUP BY 1)
    SELECT b.key, count(*) AS rows, count(*) - count(b.close) AS close_nulls, count(n.news_count) AS covered_rows, 1 AS excluded_absent FROM bars b LEFT JOIN n ON n.day = b.day GROUP BY b.key""",
)
def integration_validation(spark, sf):
    joined = bars(spark, sf).join(daily_orders(spark, sf), "day", "left")
    return ql.validate_integration(joined, ["key"], ["close"], "news_count", excluded=["merge_date"])


@query("feature_opportunities")
def feature_opportunities(spark, sf):
    return ql.feature_opportunities(table(spark, sf, "events"))


@query(
    "datetime_standardisation",
    "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+0000') END AS s_std FROM events",
)
def datetime_standardisation(spark, sf):
    from marketweave.plans.q_text import _date_strings

    return ql.standardise_datetimes(_date_strings(spark, sf), ["s"])[0].select("event_id", "s_std")


@query(
    "datetime_success_rates",
    "SELECT 's' AS \"column\", 0::BIGINT AS null_before, count(*) FILTER (event_id % 4 = 3) AS null_after, round(count(*) FILTER (event_id % 4 <> 3) / count(*) * 100, 6) AS success_rate FROM events",
)
def datetime_success_rates(spark, sf):
    from marketweave.plans.q_text import _date_strings

    df = _date_strings(spark, sf).select("event_id", F.col("s").alias("created_s"))
    cols = ql.datetime_candidates(df)
    return ql.standardise_datetimes(df, cols)[1].select(F.expr("replace(column, 'created_', '')").alias("column"), "null_before", "null_after", r("success_rate").alias("success_rate"))


@query("repaired_quality_report")
def repaired_quality_report(spark, sf):
    """Quality scores before and after the repair of infinite and extreme values."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("value") > 20, float("inf")).otherwise(F.col("value")).alias("v"))
    fixed = ql.repair(e.select(F.col("event_id").cast("string").alias("event_id"), "event_type", "v"), floors={"v": 1.0})
    return ql.quality_scores(e, "before").unionByName(ql.quality_scores(fixed, "after"))


@query("ranked_datasets", f"SELECT dataset, rows, CAST(row_number() OVER (ORDER BY rows DESC, dataset) AS INT) AS rank FROM ({sql_inventory()})")
def ranked_datasets(spark, sf):
    from marketweave.operators.labels import top_k

    found = inventory(spark, table_paths(sf))
    return top_k(found, F.col("rows"), ["dataset"], len(TABLES)).select("dataset", "rows", "rank")


@query("prepared_orders")
def prepared_orders(spark, sf):
    """The whole preparation chain over the orders."""
    from marketweave.plans.workflows import prepare_table

    return prepare_table(table(spark, sf, "orders"), keep=["o_orderkey", "o_custkey"])


@query("prepared_documents")
def prepared_documents(spark, sf):
    from marketweave.plans.workflows import prepare_table

    return prepare_table(table(spark, sf, "documents"), text=["text"], keep=["doc_id"])
