"""Benchmark decontamination as a prefix-filtered set join.

Words are runs of digits, a-z and characters beyond ASCII after lower-casing A-Z. A benchmark item
is the set of its windows: every ``window`` consecutive words, or the whole item if it is shorter.
A document word inside any occurrence of a window is hit.

1. *Candidate runs.* One pass over the documents keeps the maximal runs of words that are covered by
   shingles (``shingle`` consecutive words) of the benchmark, and of these only the runs that are
   long enough to hold the shortest window (length bound). The shingles are sent to the workers in
   slices of at most ``slice_words`` benchmark words; a larger benchmark makes more passes.
2. *Prefix join.* Shingles are ordered by rarity in the candidate runs of all documents. Exact
   containment needs every shingle of a window, so a prefix of one suffices: windows and runs are
   joined on the rarest shingle of each window.
3. *Verification.* The position of the shingle fixes where the window would start; it must lie in
   the run (positional bound) and its words must equal the run's words there.

Edge cases: null or wordless texts have no words and no hits; wordless items have no windows; items
without an id count for hits but are not listed; rows with equal id and text get equal results;
columns other than the ids and texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import byte_texts, spool, text_digest, text_rows

# fixed values: bytes that belong to words, A-Z in lower case, everything else a blank
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
RUN_SCHEMA = "doc_id {id_type}, digest binary, n_words long, runs array<struct<start:int,words:array<string>>>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class ShingleIndex:
    """Membership of word shingles of the sizes 1..k, with words numbered from 0."""

    def __init__(self, items: list[list[bytes]], window: int, shingle: int):
        self.ids: dict[bytes, int] = {}
        self.shortest = min((min(len(x), window) for x in items), default=window)
        keys: dict[int, set[int]] = {}
        for words in items:
            size = min(shingle, len(words))
            numbers = [self.ids.setdefault(w, len(self.ids)) for w in words]
            keys.setdefault(size, set()).update(self._key(numbers[i : i + size]) for i in range(len(words) - size + 1))
        self.keys = {size: np.array(sorted(k), dtype=np.uint64) for size, k in keys.items()}

    @staticmethod
    def _key(numbers: list[int]) -> int:
        key = 0
        for n in numbers:
            key = (key * 0x9E3779B97F4A7C15 + n + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words lie in a benchmark shingle. Keys are hashes: a false one only adds work."""
        get = self.ids.get
        numbers = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = numbers >= 0
        out = np.zeros(len(words), dtype=bool)
        numbers = numbers.astype(np.uint64) + np.uint64(1)
        for size, keys in self.keys.items():
            n = len(words) - size + 1
            if n <= 0:
                continue
            start = known[:n].copy()
            key = np.zeros(n, dtype=np.uint64)
            for i in range(size):
                start &= known[i : n + i]
                key = key * np.uint64(0x9E3779B97F4A7C15) + numbers[i : n + i]
            at = np.flatnonzero(start)
            found = key[at]
            spot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            at = at[keys[spot] == found]
            for i in range(size):
                out[at + i] = True
        return out


def _runs(index: ShingleIndex, words: list[bytes]) -> list[dict]:
    if len(words) < index.shortest or not index.keys:
        return []
    edge = np.diff(np.concatenate(([0], index.covered(words).view(np.int8), [0])))
    return [
        {"start": int(a), "words": [w.decode("utf-8", "replace") for w in words[a:b]]}
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
        if b - a >= index.shortest
    ]


def _candidates(index_of, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            sizes, runs = [], []
            for text in byte_texts(batch.column(1)):
                words = split_words(text)
                sizes.append(len(words))
                runs.append(_runs(index, words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(runs, schema.field("runs").type),
                ],
                schema=schema,
            )

    return run


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item, window number, words of the window and its shingles with their offsets."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    width = F.least(F.lit(window), F.size("words"))
    size = F.least(F.lit(shingle), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - width + 1)
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"), size.alias("size"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, slice_words: int = 2_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans of hit words."""
    spark = documents.sparkSession
    docs = text_rows(documents, "doc_id", "text", text_digest("text").alias("digest"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run_schema = spark.createDataFrame([], RUN_SCHEMA.format(id_type=id_type)).schema
    arrow = to_arrow_schema(run_schema)
    windows = spool(benchmark_windows(benchmark, window, shingle), "windows")
    bench = benchmark.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = bench.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2
    slices = max(1, -(-int(total) // slice_words))
    parts = []
    for k in range(slices):
        texts = bench.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).toLocalIterator()
        items = [w for w in (split_words(r.text.encode()) for r in texts) if w]
        index = spark.sparkContext.broadcast(ShingleIndex(items, window, shingle))
        parts.append(spool(docs.mapInArrow(_candidates(index, arrow), run_schema), "runs"))
    rows = parts[0].select("doc_id", "digest", "n_words")
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.union(p)
    runs = runs.where(F.size("runs") > 0).dropDuplicates(["doc_id", "digest", "runs"])
    runs = runs.select("doc_id", "digest", F.explode("runs").alias("run")).select("doc_id", "digest", "run.start", "run.words")

    def shingles(words: str, size):
        return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))

    sizes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(shingle)), lambda i: F.least(i, F.size("words"))))
    seen = runs.select("doc_id", "digest", "start", "words", F.explode(sizes).alias("size"))
    # a run meets shingles of smaller sizes only where the benchmark has items that short
    short = windows.select("size").distinct()
    seen = seen.join(F.broadcast(short), "size")
    seen = seen.select("doc_id", "digest", "start", "words", F.posexplode(shingles("words", F.col("size"))).alias("at", "key"))

    rarity = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    distinct = windows.groupBy("window", "size").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    keyed = distinct.select("window", F.posexplode(shingles("window", F.col("size"))).alias("offset", "key"))
    # a shingle that no run holds rules its window out, so the join keeps what can occur
    total_keys = F.size("window") - F.least(F.lit(shingle), F.size("window")) + 1
    prefix = (
        keyed.join(rarity, "key")
        .groupBy("window")
        .agg(F.min(F.struct("n", "key", "offset")).alias("rarest"), F.count(F.lit(1)).alias("present"))
        .where(F.col("present") == total_keys)
        .select("window", F.col("rarest.key").alias("key"), F.col("rarest.offset").alias("offset"))
    )
    found = (
        seen.join(prefix, "key")
        .withColumn("from", F.col("at") - F.col("offset"))
        .where((F.col("from") >= 0) & (F.col("from") + F.size("window") <= F.size("words")))
        .where(F.slice("words", F.col("from") + 1, F.size("window")) == F.col("window"))
        .select("doc_id", "digest", "window", (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("from") + F.size("window")).alias("b"))
    )
    found = spool(found, "hits")
    # the union of the hit spans of a document; their number is bounded by its words
    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("a", "b"))),
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )
    spans = found.groupBy("doc_id", "digest").agg(merged.alias("spans"))
    by_item = windows.where(F.col("item").isNotNull()).select("window", "item").distinct()
    items = (
        found.select("doc_id", "digest", "window").distinct().join(by_item, "window")
        .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = spans.join(items.withColumnsRenamed({"doc_id": "i", "digest": "d"}), (F.col("doc_id").eqNullSafe(F.col("i"))) & (F.col("digest") == F.col("d")), "left")
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"), "spans", "items")
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest")), "left")
    n_hit = F.aggregate(F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")), F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", F.expr("cast(array() as array<string>)"))).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "digest",
        F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")).alias("spans"),
    )


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    found = contamination(documents, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
