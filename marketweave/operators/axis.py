"""Ordered panels: which columns identify a series, how its rows are ordered, and whether the
rows of one series are known to be few.

A window over one key runs in one task. That is fine for bars, whose row count per key is
limited by the calendar, and wrong for raw events, where one key may hold a third of the table.
``Axis.bounded`` states which case it is. Unbounded series are cut into blocks of
``block_rows`` consecutive rows; each block also receives the ``back`` rows before it and the
``ahead`` rows after it, so every result is the same as in one long window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = dict[str, Callable[["Frames"], Column]]


@dataclass(frozen=True)
class Axis:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    bounded: bool = False
    bucket: str | None = None
    """date_trunc unit used to number the rows of an unbounded series in parallel; chosen from the
    fullest day of the fullest series when not given."""
    block_rows: int = 200_000


class Frames:
    """The windows a stage may use."""

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        self.keys = list(keys)
        self.order = list(order)
        self.w = Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def running(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def over(self, agg: Callable, c, n: int) -> Column:
        return agg(c).over(self.rows(n))

    def full(self, n: int, agg: Callable, c) -> Column:
        """Null until n non-null values lie in the frame."""
        frame = self.rows(n)
        return F.when(F.count(c).over(frame) == n, agg(c).over(frame))

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)


BUCKET_ROWS = 1_000_000


def bucket_unit(df: DataFrame, axis: Axis) -> str:
    """Coarsest unit for which no bucket of a series should hold more than BUCKET_ROWS rows."""
    if axis.bucket:
        return axis.bucket
    per_day = df.groupBy(*axis.keys, F.to_date(axis.order[0]).alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    fullest = per_day.agg(F.max("__n")).first()[0] or 0
    for unit, per in (("day", 1), ("hour", 24), ("minute", 24 * 60)):
        if fullest / per <= BUCKET_ROWS:
            return unit
    return "second"


def number_rows(df: DataFrame, axis: Axis, name: str = "__rn", size: str | None = None) -> DataFrame:
    """0-based row number per series, and the row count of the series when ``size`` is given.
    Unbounded series are numbered per time bucket and shifted by the counts of the earlier
    buckets, so no task sees a whole series."""
    keys = list(axis.keys)
    if axis.bounded:
        part = Window.partitionBy(*keys)
        out = df.withColumn(name, (F.row_number().over(part.orderBy(*axis.order)) - 1).cast("long"))
        return out.withColumn(size, F.count(F.lit(1)).over(part)) if size else out
    bucketed = df.withColumn("__bucket", F.date_trunc(bucket_unit(df, axis), F.col(axis.order[0])))
    counts = bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        *([F.sum("__n").over(Window.partitionBy(*keys)).alias(size)] if size else []),
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))]
    joined = bucketed.join(offsets, on, "left")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*axis.order)
    return joined.withColumn(name, (F.col("__offset") + F.row_number().over(inside) - 1).cast("long")).drop(
        *[f"__k_{k}" for k in keys], "__b", "__bucket", "__offset"
    )


def cut_blocks(df: DataFrame, axis: Axis, back: int, ahead: int) -> DataFrame:
    """Add ``__blk`` and ``__ctx``; rows near a block edge appear again as context."""
    size = max(axis.block_rows, back, ahead, 1)
    numbered = number_rows(df, axis)
    blk = F.floor(F.col("__rn") / size).cast("long")
    pos = F.col("__rn") % size
    copies = [F.struct(blk.alias("__blk"), F.lit(False).alias("__ctx"))]
    if back:
        copies.append(F.when(pos >= size - back, F.struct((blk + 1).alias("__blk"), F.lit(True).alias("__ctx"))))
    if ahead:
        copies.append(
            F.when((pos < ahead) & (blk > 0), F.struct((blk - 1).alias("__blk"), F.lit(True).alias("__ctx")))
        )
    return numbered.withColumn("__copy", F.explode(F.array_compact(F.array(*copies)))).select(
        "*", "__copy.__blk", "__copy.__ctx"
    ).drop("__copy", "__rn")


def chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], stages: Sequence[Stage]) -> DataFrame:
    frames = Frames(keys, order)
    for stage in stages:
        df = df.withColumns({name: build(frames) for name, build in stage.items()})
    return df


def apply_stages(
    df: DataFrame, axis: Axis, stages: Sequence[Stage], back: int = 0, ahead: int = 0, drop: Sequence[str] = ()
) -> DataFrame:
    """Run window stages one after another. ``back``/``ahead`` is the number of neighbouring rows
    the whole chain looks at."""
    if axis.bounded:
        return chain(df, axis.keys, axis.order, stages).drop(*drop)
    blocks = cut_blocks(df, axis, back, ahead)
    out = chain(blocks, [*axis.keys, "__blk"], axis.order, stages)
    return out.filter(~F.col("__ctx")).drop("__blk", "__ctx", *drop)


def running(df: DataFrame, axis: Axis, specs: dict[str, tuple[str, Column]], reverse: bool = False) -> DataFrame:
    """Running aggregates from the start of each series (or from its end with ``reverse``).

    ``specs`` maps output name to (kind, input), kind one of sum, max, min, last (last non-null).
    Unbounded series: one partial value per time bucket, a prefix over the buckets, then a window
    inside each bucket.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    order = [F.col(o).desc() for o in axis.order] if reverse else [F.col(o) for o in axis.order]
    keys = list(axis.keys)
    if axis.bounded:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: agg[kind](c).over(w) for name, (kind, c) in specs.items()})

    def combine(kind: str, earlier: Column, later: Column) -> Column:
        if kind == "sum":
            return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(earlier + later)
        if kind == "last":
            return F.coalesce(later, earlier)
        return (F.greatest if kind == "max" else F.least)(earlier, later)

    inputs = df.withColumns({f"__in_{n}": c for n, (_, c) in specs.items()}).withColumn(
        "__bucket", F.date_trunc(bucket_unit(df, axis), F.col(axis.order[0]))
    )
    rank = F.struct(*axis.order)
    partial = {
        "sum": lambda c: F.sum(c),
        "max": lambda c: F.max(c),
        "min": lambda c: F.min(c),
        "last": lambda c: (F.min_by if reverse else F.max_by)(c, F.when(c.isNotNull(), rank)),
    }
    per_bucket = inputs.groupBy(*keys, "__bucket").agg(
        *[partial[kind](F.col(f"__in_{n}")).alias(f"__p_{n}") for n, (kind, _) in specs.items()]
    )
    bucket_order = F.col("__bucket").desc() if reverse else F.col("__bucket")
    before = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_bucket.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bucket").alias("__b"),
        *[agg[kind](F.col(f"__p_{n}")).over(before).alias(f"__before_{n}") for n, (kind, _) in specs.items()],
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))]
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = inputs.join(prefix, on, "left")
    out = joined.withColumns(
        {
            n: combine(kind, F.col(f"__before_{n}"), agg[kind](F.col(f"__in_{n}")).over(inside))
            for n, (kind, _) in specs.items()
        }
    )
    return out.select(*df.columns, *specs)
