"""Dictionaries that are looked up inside the row: no join, no row per word.

The entries are dealt to buckets by the crc32 of their key. The buckets are one constant of the plan,
an array of strings, and a lookup looks at the few entries of one string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketweave.functions.num import bound

BUCKET, ENTRY, FIELD = "\x1c", "\x1d", "\x1e"


class Dictionary:
    def __init__(self, entries: Iterable[Sequence], fields: str):
        """``entries`` are (key, *values); ``fields`` names and types the values. A key may have
        several entries. Keys and values must not hold the three separators."""
        rows = [[str(v) for v in entry] for entry in entries]
        if any(sign in v for row in rows for v in row for sign in (BUCKET, ENTRY, FIELD)):
            raise ValueError("keys and values must not hold the signs 1C, 1D and 1E")
        self.fields = [f.split() for f in fields.split(", ")]
        self.size = max(2, 2 * len(rows))
        buckets: list[list[str]] = [[] for _ in range(self.size)]
        for row in rows:
            buckets[zlib.crc32(row[0].encode()) % self.size].append(FIELD.join(row))
        # the split of a constant is a constant
        self.buckets = F.split(F.lit(BUCKET.join(ENTRY.join(b) for b in buckets)), BUCKET)

    def find(self, key: Column) -> Column:
        """The entries of a key as structs, an empty array if there is none."""
        bucket = F.get(self.buckets, F.pmod(F.crc32(key), F.lit(self.size)).cast("int"))
        hits = F.filter(F.split(bucket, ENTRY), lambda e: F.startswith(e, F.concat(key, F.lit(FIELD))))

        def typed(parts: Column) -> Column:
            return F.struct(F.get(parts, F.lit(0)).alias("key"), *[F.get(parts, F.lit(i)).cast(kind).alias(n) for i, (n, kind) in enumerate(self.fields, 1)])

        return F.transform(hits, lambda e: bound(F.split(e, FIELD), typed))

    def find_all(self, keys: Column) -> Column:
        """The entries of all elements, in their order."""
        return F.flatten(F.transform(keys, self.find))
