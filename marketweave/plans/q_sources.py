"""Queries for sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions.num import r
from marketweave.operators import scaling as scl
from marketweave.plans.q_trading import sql_book
from marketweave.plans.registry import query
from marketweave.plans.roles import table
from marketweave.session import new_shared_path
from marketweave.sources import readers as rd
from marketweave.streaming import stateful as states
from marketweave.streaming import streams as st


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = new_shared_path(spark, "orders") + ".csv"
    rd.save_data(o, path, "csv")
    return rd.read_csv(spark, path, o.schema)


@query("json_round_trip", "SELECT doc_id, text, lang FROM documents")
def json_round_trip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = new_shared_path(spark, "documents")
    rd.save_data(d, path, "json")
    return spark.read.schema(d.schema).json(path)


@query("dataset_files")
def dataset_files(spark, sf):
    return rd.scan_datasets(spark, sf).select("dataset", "kind", "bytes")


@query("first_rows_of_a_source")
def first_rows_of_a_source(spark, sf):
    return rd.inspect(table(spark, sf, "orders"), 5)


@query(
    "nested_feed_rows",
    "SELECT CAST(doc_id AS VARCHAR) AS url, source, text AS summary, round(n_chars / 1000.0, 6) AS overall_sentiment, lang AS ticker, round(n_chars / 100.0, 6) AS ticker_score FROM documents",
)
def nested_feed_rows(spark, sf):
    """Each document as the JSON answer of a sentiment feed, parsed back into rows."""
    d = table(spark, sf, "documents")
    one = F.struct(
        F.col("text").alias("summary"), F.col("doc_id").cast("string").alias("url"), "source", (F.col("n_chars") / 1000.0).alias("overall_sentiment_score"),
        F.array(F.struct(F.col("lang").alias("ticker"), (F.col("n_chars") / 100.0).cast("string").alias("ticker_sentiment_score"))).alias("ticker_sentiment"),
    )
    raw = d.select(F.to_json(F.struct(F.array(one).alias("feed"))).alias("value"))
    out = rd.sentiment_feed(raw)
    return out.select("url", "source", "summary", r("overall_sentiment").alias("overall_sentiment"), F.explode("ticker_sentiment").alias("ticker", "ticker_score")).withColumn("ticker_score", r("ticker_score"))


@query("article_page_rows", "SELECT source, CAST(doc_id AS VARCHAR) AS url, text AS content, lang AS query FROM documents")
def article_page_rows(spark, sf):
    d = table(spark, sf, "documents")
    one = F.struct(F.struct(F.col("source").alias("name")).alias("source"), F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"))
    raw = d.select(F.col("lang").alias("query"), F.to_json(F.struct(F.array(one).alias("articles"))).alias("value"))
    return rd.article_pages(raw).select("source", "url", "content", "query")


@query("json_properties", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def json_properties(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "collection_summary",
    " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS records FROM {t}" for t in ("orders", "events", "documents", "conversations")),
)
def collection_summary(spark, sf):
    return rd.collection_summary({t: table(spark, sf, t) for t in ("orders", "events", "documents", "conversations")})


@query("saved_scaler_parameters", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value_scaled FROM events")
def saved_scaler_parameters(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    path = new_shared_path(spark, "scaler")
    scl.save_params(spark, scl.fit(e, {"value": "standard"}), path)
    return scl.transform(e, scl.load_params(spark, path)).select("event_id", r("value_scaled").alias("value_scaled"))


@query("saved_profile_report")
def saved_profile_report(spark, sf):
    from marketweave.operators.profile import full_profile

    path = new_shared_path(spark, "report")
    rd.save_report(full_profile(table(spark, sf, "events")), path, "events")
    return spark.read.schema("section string, name string, metric string, value string, dataset string").json(path)


# -- streams ----------------------------------------------------------------------------------


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return st.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, stream, label):
    return st.run_available(stream, new_shared_path(spark, label), new_shared_path(spark, label + "-state"))


def _folders(spark, label):
    return [new_shared_path(spark, f"{label}-{part}") for part in ("out", "state", "checkpoint")]


_CLOSED = "<= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "streamed_daily_bars",
    f"""SELECT user_id, date_trunc('day', ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events
      GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY {_CLOSED}""",
)
def streamed_daily_bars(spark, sf):
    return _run(spark, st.stream_bars(_events(spark, sf), ["user_id"], "ts", "event_id", "value"), "bars").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "streamed_rolling_means",
    f"""WITH w AS (SELECT event_type, date_trunc('day', ts) + i * INTERVAL 1 DAY AS e, value FROM events, range(1, 6) t(i))
    SELECT event_type, e AS "end", round(avg(value), 9) AS mean, count(value) AS rows FROM w GROUP BY 1, 2 HAVING e {_CLOSED}""",
)
def streamed_rolling_means(spark, sf):
    out = _run(spark, st.rolling_means(_events(spark, sf), ["event_type"], "ts", "value", "5 days", "1 day"), "rolling")
    return out.select("event_type", F.col("end").cast("timestamp_ntz").alias("end"), r("mean", 9).alias("mean"), "rows")


@query(
    "streamed_entity_sentiment",
    f"""SELECT event_type, date_trunc('day', ts) AS start, round(avg(value - 10), 6) AS sentiment, count(*) AS posts FROM events GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY {_CLOSED}""",
)
def streamed_entity_sentiment(spark, sf):
    out = _run(spark, st.entity_sentiment(_events(spark, sf).withColumn("score", F.col("value") - 10), "event_type", "ts", "score"), "sentiment")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), r("sentiment").alias("sentiment"), "posts")


@query("streamed_unique_posts", "SELECT event_id, user_id FROM events")
def streamed_unique_posts(spark, sf):
    """Every event arrives twice."""
    e = _events(spark, sf)
    return _run(spark, st.unique_posts(e.unionByName(e), ["event_id"], "ts").select("event_id", "user_id"), "unique")


@query(
    "streamed_exponential_means",
    f"""WITH RECURSIVE num AS MATERIALIZED (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    e AS (SELECT user_id, event_id, rn, v AS ema FROM num WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.rn, p.ema * {11 / 13!r} + n.v * {2 / 13!r} FROM e p JOIN num n ON n.user_id = p.user_id AND n.rn = p.rn + 1)
    SELECT user_id, event_id, round(ema, 6) AS ema FROM e""",
)
def streamed_exponential_means(spark, sf):
    e = _events(spark, sf).select("user_id", "ts", "event_id", "value")
    return st.running_ema(e, *_folders(spark, "ema"), "user_id", "ts", "event_id", "value", 12).withColumn("ema", r("ema"))


@query(
    "streamed_drawdown_alerts",
    """WITH x AS (SELECT event_type, event_id, value, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events)
    SELECT event_type, event_id, peak, value FROM x WHERE peak > 0 AND (peak - value) / peak > 0.9""",
)
def streamed_drawdown_alerts(spark, sf):
    e = _events(spark, sf).select("event_type", "ts", "event_id", "value")
    return st.drawdown_alerts(e, *_folders(spark, "alerts"), "event_type", "ts", "event_id", "value", 0.9)


@query("streamed_idempotent_sink", "SELECT event_id, value FROM events WHERE value > 5")
def streamed_idempotent_sink(spark, sf):
    e = _events(spark, sf).filter(F.col("value") > 5).select("event_id", "value")
    return st.run_idempotent(e, new_shared_path(spark, "sink"), new_shared_path(spark, "sink-state"))


@query(
    "streamed_weekly_bars",
    f"""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, arg_min(value, {{'t': ts, 'i': event_id}}) AS o, max(value) AS h, min(value) AS l, arg_max(value, {{'t': ts, 'i': event_id}}) AS c, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, date_trunc('week', day) AS start, arg_min(o, day) AS open, max(h) AS high, min(l) AS low, arg_max(c, day) AS close, CAST(sum(n) AS BIGINT) AS volume, count(*) AS bars FROM d
    GROUP BY 1, 2 HAVING date_trunc('week', any_value(day)) + INTERVAL 7 DAY {_CLOSED}""",
)
def streamed_weekly_bars(spark, sf):
    """Weekly bars from the daily windows of the same stream."""
    out = _run(spark, st.coarser_bars(_events(spark, sf), ["user_id"], "ts", "event_id", "value"), "weeks")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "streamed_late_rows",
    """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
    a AS (SELECT ts, least(2, floor(3.0 * (epoch_us(ts) - lo) / (hi - lo)) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) AS k FROM events, b),
    s AS (SELECT k, rows, max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS mark FROM (SELECT k, count(*) AS rows, max(epoch_us(ts) // 1000) AS top FROM a GROUP BY k))
    SELECT CAST(s.k AS BIGINT) AS batch_id, any_value(rows) AS rows, count(*) FILTER (epoch_us(ts) <= mark * 1000) AS late, any_value(mark) AS watermark_ms FROM s JOIN a ON a.k = s.k GROUP BY s.k""",
)
def streamed_late_rows(spark, sf):
    """The events arrive in three parts of time, some of them a part too late; the stream is
    restarted for every part."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    third = F.floor(3.0 * (F.unix_micros("ts") - low) / (high - low)) + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)
    source, out, counts, checkpoint = (new_shared_path(spark, f"late-{part}") for part in ("source", "out", "counts", "checkpoint"))
    for part in range(3):
        e.where(F.least(third, F.lit(2)) == part).write.mode("append").parquet(source)
        found = st.gated_sink(st.file_stream(spark, source, e.schema), "ts", 3_600_000, out, counts, checkpoint)
    return found.select("batch_id", "rows", "late", "watermark_ms")


_CLOSED_ROWS = "c AS (SELECT * FROM events WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events))"
_TRADE = "CASE WHEN event_id % 5 < 2 THEN 'SELL' ELSE 'BUY' END"


@query(
    "streamed_position_book",
    f"""WITH RECURSIVE {_CLOSED_ROWS}, {sql_book(f"SELECT user_id AS key, ts AS t, event_id AS tie, {_TRADE} AS action, 1 + event_id % 7 AS q, value + 1 AS p FROM c")}
    SELECT b.key AS user_id, tie AS event_id, action, done AS executed, held AS position, round(price, 6) AS avg_price, round(pnl, 6) AS pnl, short AS is_short FROM book b JOIN num2 n ON n.key = b.key AND n.rn = b.rn""",
)
def streamed_position_book(spark, sf):
    """An average-cost book per user over the events as trades, in typed state."""
    e = _events(spark, sf).select(
        "user_id", "ts", "event_id", F.when(F.col("event_id") % 5 < 2, "SELL").otherwise("BUY").alias("action"), (1 + F.col("event_id") % 7).alias("quantity"), (F.col("value") + 1).alias("price")
    )
    out = states.run_stateful(spark, states.stream_positions(e, "user_id", "ts", "event_id"), new_shared_path(spark, "book"), new_shared_path(spark, "book-state"))
    return out.select("user_id", "event_id", "action", "executed", "position", r("avg_price").alias("avg_price"), r("pnl").alias("pnl"), "is_short")


@query(
    "streamed_model_drift",
    f"""WITH {_CLOSED_ROWS}, m AS (SELECT event_type, event_id, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS rows, avg(value) OVER (w ROWS 99 PRECEDING) AS a, avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 100 PRECEDING) AS b,
      avg(value) OVER (w ROWS 9 PRECEDING) AS l FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
    SELECT event_type, event_id, rows, round(a + 3.3e-8, 6) AS recent_error, round(b + 3.3e-8, 6) AS historical_error, round(l + 3.3e-8, 6) AS last_10_error, CAST(coalesce(a > 1.02 * b, false) AS INT) AS drift, CAST(rows > 10 AND l > 0.1 AS INT) AS high_error FROM m""",
)
def streamed_model_drift(spark, sf):
    """Values of an event type as the errors of a model; a low factor, so that there are alerts.
    The shift keeps means that end in an exact half off the edge of rounding."""
    rows = states.stream_drift(_events(spark, sf), "event_type", "ts", "event_id", "value", factor=1.02)
    out = states.run_stateful(spark, rows, new_shared_path(spark, "drift"), new_shared_path(spark, "drift-state"))
    return out.select("event_type", "event_id", "rows", *[r(F.col(c) + 3.3e-8).alias(c) for c in ("recent_error", "historical_error", "last_10_error")], "drift", "high_error")
