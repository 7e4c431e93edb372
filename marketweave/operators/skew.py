"""Joining rows to per-key values when one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.session import cut

HOT_SHARE = 1000


def join_key_values(rows: DataFrame, values: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with one ``values`` row per key; ``count`` is the number of rows per key.

    Keys above 1/1000 of all rows number at most 1000, so their values are broadcast and their
    rows stay where they are; only rows of the other keys are shuffled.
    """
    keys = list(keys)
    values = cut(values)
    total = values.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total / HOT_SHARE
    hot = values.filter(is_hot)
    names = [c for c in values.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    heavy = marked.filter("__hot").drop("__hot")
    light = marked.filter(F.col("__hot").isNull()).drop("__hot", *names)
    return heavy.unionByName(light.join(values.filter(~is_hot), keys, "inner"))


def row_digest(df: DataFrame, cols: Sequence[str]):
    """A 256-bit digest of the row: the grouping key for exact copies without shuffling the rows.

    JSON would cut times to milliseconds, so they enter as microseconds; 0.0 and -0.0 are equal.
    Nulls drop out of the JSON text, whose field names keep the other columns apart.
    """

    def exact(c: str):
        kind = df.schema[c].dataType
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(c).alias(c)
        if isinstance(kind, T.TimestampNTZType):
            return F.col(c).cast("string").alias(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return (F.col(c) + F.lit(0.0).cast(kind)).cast("string").alias(c)
        return F.col(c)

    return F.sha2(F.to_json(F.struct(*[exact(c) for c in cols])), 256)
