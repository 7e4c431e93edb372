"""Streaming versions: bars, rolling windows, de-duplication, state per key, alerts, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.operators.axis import Axis, running
from marketweave.operators.series import exponential_averages
from marketweave.session import cut, new_shared_path

COUNTS = "batch_id long, rows long, late long, watermark_ms long, seen_ms long"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder. ``files_per_batch`` limits the rows of one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_bars(ticks: DataFrame, keys: Sequence[str], ts: str, tie: str, price: str, volume: str | None = None, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Open, high, low, close, volume per key and tumbling window."""
    out = _windowed_bars(ticks, keys, ts, tie, price, volume, width, delay)
    return out.select(*keys, F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def _windowed_bars(ticks: DataFrame, keys: Sequence[str], ts: str, tie: str, price: str, volume: str | None, width: str, delay: str) -> DataFrame:
    at = F.struct(ts, tie)
    return ticks.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width)).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        (F.sum(volume) if volume else F.count(F.lit(1))).alias("volume"),
    )


def coarser_bars(
    ticks: DataFrame, keys: Sequence[str], ts: str, tie: str, price: str, volume: str | None = None, fine: str = "1 day", coarse: str = "7 days", offset: str = "4 days", delay: str = "1 hour"
) -> DataFrame:
    """Weekly bars (from Mondays) made of the daily bars of the same stream: the closed daily
    windows feed a second aggregation, whose state holds one row per key and week and not ticks."""
    bars = _windowed_bars(ticks, keys, ts, tie, price, volume, fine, delay)
    day = F.col("window.start")
    out = bars.groupBy(*keys, F.window(F.window_time("window"), coarse, coarse, offset).alias("wide")).agg(
        F.min_by("open", day).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", day).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars"),
    )
    return out.select(*keys, F.col("wide.start").alias("start"), "open", "high", "low", "close", "volume", "bars")


def rolling_means(ticks: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "20 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Time-based rolling mean per key (the batch operators count rows, a stream counts time)."""
    out = ticks.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width, slide)).agg(F.avg(value).alias("mean"), F.count(value).alias("rows"))
    return out.select(*keys, F.col("window.end").alias("end"), "mean", "rows")


def entity_sentiment(posts: DataFrame, entity: str, ts: str, score: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    out = posts.withWatermark(ts, delay).groupBy(entity, F.window(ts, width)).agg(
        F.avg(score).alias("sentiment"), F.count(F.lit(1)).alias("posts")
    )
    return out.select(entity, F.col("window.start").alias("start"), "sentiment", "posts")


def unique_posts(posts: DataFrame, key: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each post within the watermark."""
    return posts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def carried_state(stream: DataFrame, out: str, state: str, checkpoint: str, key: str, ts: str, tie: str, value: str, step, result: str) -> DataFrame:
    """A running quantity per key over micro-batches, without gathering a key in one task.

    ``step`` maps the rows of a batch, with one earlier row per known key whose value is the
    quantity so far, to rows with ``result``: a batch operator that cuts long series into blocks.
    The state is the last result of every key; each batch writes its own folders, so a repeated
    batch changes nothing.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, ts, tie)}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", {value} double"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{state}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        rows = batch.select(key, ts, tie, F.col(value).cast("double").alias(value), F.lit(1).alias("__new"))
        early = F.lit("1900-01-01").cast(kinds[ts]).alias(ts)  # the state comes before rows of any time
        both = before.select(key, early, tie, value, F.lit(0).alias("__new")).unionByName(rows)
        done = cut(step(both))
        done.where("__new = 1").select(key, tie, value, result).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last = F.max_by(F.struct(ts, tie, result), F.struct("__new", ts, tie)).alias("__last")
        left = done.groupBy(key).agg(last).select(key, f"__last.{ts}", f"__last.{tie}", F.col(f"__last.{result}").cast("double").alias(value))
        left.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{key} {kinds[key]}, {tie} {kinds[tie]}, {value} double, {result} double").parquet(f"{out}/batch=*")


def _carried_axis(key: str, ts: str, tie: str) -> Axis:
    return Axis(keys=(key,), order=(ts, "__new", tie))


def running_ema(ticks: DataFrame, out: str, state: str, checkpoint: str, key: str, ts: str, tie: str, value: str, span: int = 12) -> DataFrame:
    """Exponential mean per key: the mean so far is the first value of the next batch."""

    def step(rows: DataFrame) -> DataFrame:
        return exponential_averages(rows, _carried_axis(key, ts, tie), value, (span,)).withColumnRenamed(f"ema_{span}", "ema")

    return carried_state(ticks, out, state, checkpoint, key, ts, tie, value, step, "ema").select(key, tie, "ema")


def drawdown_alerts(equity: DataFrame, out: str, state: str, checkpoint: str, key: str, ts: str, tie: str, value: str, limit: float = 0.5) -> DataFrame:
    """Rows whose value lies more than ``limit`` below the highest value of the key so far."""

    def step(rows: DataFrame) -> DataFrame:
        return running(rows, _carried_axis(key, ts, tie), {"peak": ("max", F.col(value))})

    done = carried_state(equity, out, state, checkpoint, key, ts, tie, value, step, "peak")
    return done.where((F.col("peak") > 0) & ((F.col("peak") - F.col(value)) / F.col("peak") > limit)).select(key, tie, "peak", value)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, append to a Parquet folder, and read the folder back."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_idempotent(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Each micro-batch owns one folder and overwrites it, so a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out).select(*stream.columns)


def gated_sink(stream: DataFrame, ts: str, delay_ms: int, out: str, counts: str, checkpoint: str) -> DataFrame:
    """Rows in time go to ``out/batch=*/late=false``, rows behind the watermark beside them to
    ``late=true``, from where they can be repaired; the counts per batch are returned.

    The watermark of a batch is the largest event time of the batches before it, less the delay, as
    the engine's own. Each batch counts its rows while it writes them (observed metrics, one pass),
    and owns its folders: a repeated batch counts once, a restart goes on from the folder of the
    batch before, and no batch is forgotten however many there are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema(COUNTS).parquet(f"{counts}/batch={batch_id - 1}").first()["seen_ms"] if batch_id else None
        mark = None if seen is None else seen - delay_ms
        late = F.lit(False) if mark is None else F.coalesce(F.unix_micros(ts) <= mark * 1000, F.lit(False))
        noted = Observation()
        found = (F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.max(F.unix_millis(ts)).alias("top"))
        batch.withColumn("late", late).observe(noted, *found).write.partitionBy("late").mode("overwrite").parquet(f"{out}/batch={batch_id}")
        n = noted.get
        top = max((v for v in (seen, n["top"]) if v is not None), default=None)
        spark.createDataFrame([(batch_id, n["rows"], n["late"], mark, top)], COUNTS).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(COUNTS).parquet(f"{counts}/batch=*")
