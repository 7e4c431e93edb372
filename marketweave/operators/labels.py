"""Forward-looking labels, buckets, ranking, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.num import sdiv
from marketweave.operators.axis import Axis, Stage, apply_stages, number_rows
from marketweave.operators.quantiles import exact_quantiles


def next_return(df: DataFrame, axis: Axis, price: str = "close", drop_last: bool = True) -> DataFrame:
    """Return of the next row and its sign; the last row of a series has no label."""
    stages: list[Stage] = [
        {"target_return": lambda f: sdiv(f.lead(price), F.col(price)) - 1},
        {"target_up": lambda f: (F.col("target_return") > 0).cast("int")},
    ]
    out = apply_stages(df, axis, stages, ahead=1)
    return out.dropna(subset=["target_return"]) if drop_last else out


def forward_direction(df: DataFrame, axis: Axis, price: str = "close", horizons: Sequence[int] = (3, 10)) -> DataFrame:
    stage: Stage = {
        f"up_{h}d": (lambda f, h=h: (sdiv(f.lead(price, h), F.col(price)) - 1 > 0).cast("int")) for h in horizons
    }
    return apply_stages(df, axis, [stage], ahead=max(horizons))


def forward_return(df: DataFrame, axis: Axis, price: str = "close", horizon: int = 5) -> DataFrame:
    return apply_stages(
        df, axis, [{f"forward_return_{horizon}": lambda f: sdiv(f.lead(price, horizon), F.col(price)) - 1}], ahead=horizon
    )


def movement_class(ret: Column) -> Column:
    """Four right-closed buckets around zero."""
    return (
        F.when(ret <= -0.02, "strong_down").when(ret <= 0, "slight_down").when(ret <= 0.02, "slight_up").when(ret > 0.02, "strong_up")
    )


def forward_volatility(df: DataFrame, axis: Axis, price: str = "close", n: int = 5) -> DataFrame:
    stages: list[Stage] = [
        {"__ret": lambda f: sdiv(F.col(price), f.lag(price)) - 1},
        {"__vol": lambda f: f.full(n, F.stddev_samp, "__ret")},
        {"target_volatility": lambda f: f.lead("__vol")},
    ]
    return apply_stages(df, axis, stages, back=n, ahead=1, drop=("__ret", "__vol"))


def direction_class(df: DataFrame, axis: Axis, c: str) -> DataFrame:
    return apply_stages(df, axis, [{"direction": lambda f: (F.col(c) > f.lag(c)).cast("int")}], back=1)


def top_k(df: DataFrame, by: Column, tie: Sequence[str], k: int) -> DataFrame:
    """The k largest rows with their rank. Spark takes k rows per partition before merging."""
    best = df.orderBy(by.desc(), *tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(by.desc(), *tie)))


def best_per_group(df: DataFrame, group: Sequence[str], by: Column, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """One row per group by max_by, which combines on the map side, unlike a ranking window."""
    others = [c for c in df.columns if c not in group]
    rank = F.struct((by if largest else -by).alias("m"), *[(-F.col(t)).alias(t) for t in tie])
    picked = df.groupBy(*group).agg(F.max_by(F.struct(*others), rank).alias("__row"))
    return picked.select(*group, *[F.col(f"__row.{c}").alias(c) for c in others])


def quantile_buckets(df: DataFrame, c: str, q: int = 3, name: str = "bucket") -> DataFrame:
    """Equal-count buckets 0..q-1 from exact edges, right-closed, lowest edge included."""
    edges = exact_quantiles(df, [c], [i / q for i in range(1, q)])[c]
    bucket = F.lit(q - 1)
    for i in reversed(range(q - 1)):
        bucket = F.when(F.col(c) <= F.lit(edges[i]), F.lit(i)).otherwise(bucket)
    return df.withColumn(name, F.when(F.col(c).isNotNull(), bucket))


# -- splits -----------------------------------------------------------------------------------


def _with_position(df: DataFrame, axis: Axis) -> DataFrame:
    return number_rows(df, axis, "__pos", size="__size")


def chronological_split(df: DataFrame, axis: Axis, test_share: float = 0.2) -> DataFrame:
    """First floor(n*(1-share)) rows of each series are train, the rest test."""
    out = _with_position(df, axis)
    edge = F.floor(F.col("__size") * (1 - test_share))
    return out.withColumn("split", F.when(F.col("__pos") < edge, "train").otherwise("test")).drop("__pos", "__size")


def expanding_folds(df: DataFrame, axis: Axis, folds: int = 3) -> DataFrame:
    """One row per input row and fold it takes part in: test blocks of n // (folds + 1) rows at the
    end of the series, training on everything before each."""
    out = _with_position(df, axis)
    size = F.floor(F.col("__size") / (folds + 1))
    start = F.col("__size") - size * (folds - F.col("fold"))
    numbered = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("__pos") < start, "train").when(F.col("__pos") < start + size, "test")
    return numbered.withColumn("role", role).filter(F.col("role").isNotNull()).drop("__pos", "__size")


def fold_blocks(df: DataFrame, axis: Axis, folds: int = 3, name: str = "block") -> DataFrame:
    """The folds of ``expanding_folds`` with every row once: fold i tests block i + 1 and trains on the
    blocks before it; block 0 is what no fold tests."""
    out = _with_position(df, axis)
    size = F.floor(F.col("__size") / (folds + 1))
    past = F.col("__pos") - (F.col("__size") - size * folds)
    block = F.when((size == 0) | (past < 0), 0).otherwise(F.floor(past / F.greatest(size, F.lit(1))) + 1)
    return out.withColumn(name, block.cast("int")).drop("__pos", "__size")


def stratified_split(
    df: DataFrame, label: str, pk: Sequence[str], shares: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.15), ("test", 0.15)),
    buckets: int = 65536,
) -> DataFrame:
    """Exact shares inside each class in hash order of the primary key.

    A class may hold most rows, so rows are numbered per (class, hash bucket) and shifted by the
    sizes of the earlier buckets; hash order equals bucket order followed by order inside it.
    """
    h = F.xxhash64(*pk)
    width = (1 << 64) // buckets
    hashed = df.withColumn("__h", h).withColumn("__b", F.shiftright(F.col("__h"), width.bit_length() - 1))
    counts = hashed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(label).orderBy("__b")
    offsets = counts.withColumns(
        {
            "__off": F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__total": F.sum("__n").over(Window.partitionBy(label)),
        }
    ).drop("__n")
    right = offsets.withColumnsRenamed({label: "__label", "__b": "__ob"})
    joined = hashed.join(right, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__ob")))
    inside = Window.partitionBy(label, "__b").orderBy("__h", *pk)
    pos = F.col("__off") + F.row_number().over(inside) - 1
    part = F.lit(shares[-1][0])
    edges, total = [], 0.0
    for name, share in shares[:-1]:
        total += share
        edges.append((name, total))
    for name, edge in reversed(edges):
        part = F.when(F.col("__pos") < F.floor(F.col("__total") * edge), name).otherwise(part)
    return joined.withColumn("__pos", pos).withColumn("split", part).drop("__h", "__b", "__off", "__total", "__pos", "__label", "__ob")
