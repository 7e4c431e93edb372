"""Column selection by type, name or existence, and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_like(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), parts: Sequence[str] = ()) -> list[str]:
    def hit(c: str) -> bool:
        low = c.lower()
        return any(low.startswith(p) for p in prefixes) or any(low.endswith(x) for x in suffixes) or any(p in low for p in parts)

    return [c for c in df.columns if hit(c)]


def first_existing(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null value among the candidate columns that the frame has."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of {list(names)} is a column")
    return F.coalesce(*present)


def seeded_sample(df: DataFrame, pk: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(*pk, F.lit(seed)), *pk).limit(n)
