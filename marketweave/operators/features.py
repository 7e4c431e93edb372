"""Feature steps that need table-wide values first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.num import sdiv
from marketweave.session import cut

def statistical_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-score, logarithm and square root; a column the table does not allow is null, so the
    schema does not depend on the data."""
    row = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("mu", F.avg), ("sd", F.stddev_samp), ("mn", F.min))]
    ).first()
    out = {}
    for c in cols:
        mu, sd, mn = (row[f"{n}_{c}"] for n in ("mu", "sd", "mn"))
        out[f"{c}_zscore"] = (F.col(c) - F.lit(mu)) / F.lit(sd) if sd else F.lit(None).cast("double")
        out[f"{c}_log"] = F.ln(c) if mn is not None and mn > 0 else F.lit(None).cast("double")
        out[f"{c}_sqrt"] = F.sqrt(c) if mn is not None and mn >= 0 else F.lit(None).cast("double")
    return df.withColumns(out)


def encode_labels(df: DataFrame, c: str, out: str) -> DataFrame:
    """0-based code of each distinct value in sorted order: numbered inside range partitions and
    shifted by the sizes of the partitions before (one row each)."""
    values = df.select(c).dropna().distinct()
    parts = cut(values.repartitionByRange(F.col(c)).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(c)) - 1
    codes = parts.join(offsets, "__p").select(F.col(c).alias("__v"), (F.col("__o") + inside).cast("int").alias(out))
    return df.join(codes, F.col(c) == F.col("__v"), "left").drop("__v")
