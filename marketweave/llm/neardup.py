"""Near-duplicates by order min-hash, verified by banded alignment of the words.

A text is its sequence of shingles (``words`` consecutive words; a shorter text is one shingle),
each labelled with its occurrence number, so that no two are equal. A sketch takes the ``picks``
labelled shingles with the smallest hashes and keeps them in text order; texts that agree in one of
``sketches`` sketches are candidates. A candidate pair is linked if the best order-keeping alignment
of its words reaches ``threshold``: common words in order / (words of both - common). With a share x
of the words replaced this is (1 - x) / (1 + x), so 0.8 allows 11 %. Any pair whose shingles have that
similarity has it in words, too. An alignment that reaches the threshold leaves at most
(na + nb)(1 - t)/(1 + t) words over, which is the width of the band that is searched; the longest
common subsequence within the band is found with one integer of band bits per word.

Equal texts are one node from the start. A bucket of any size is not paired out: its members are
compared with two leaders: a random one, another in each sketch, and the member that shares buckets
most often, which is the text that the others were made from if there is one. Nodes that share a bucket but not a class
after that are compared among themselves by an exact prefix-filtered join (shingles by rarity, with
length and positional bounds), so that no link of shingle similarity ``threshold`` between different
texts in a bucket is lost. Rows of one class are never joined with one another there.
A pair whose shingles are exactly 0.8 alike shares no sketch with probability at most 0.4^16, below 1
in a million (4 of 5 shingles; less for longer texts). A pair with 5 % of the words replaced shares
none in 0.1 %, with 10 % in 5 % of the cases.

Edge cases: null, empty and wordless texts are classes of their own, one per row; equal texts are one
class whatever their ids; a class is named by its smallest id (null if all its ids are null); rows
with equal ids and different texts are different nodes; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import byte_texts, free_names, spool, text_digest, text_rows
from marketweave.llm.components import components
from marketweave.operators.skew import join_key_values

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Word hashes of texts in order; hashes are remembered up to a bound."""

    def __init__(self, remembered: int = 100_000):
        self.remembered = remembered
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        known, hashed = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.remembered:
            known.clear()
        numbers = [known.get(w) for w in words]
        for i, x in enumerate(numbers):
            if x is None:
                numbers[i] = known[words[i]] = hashed(words[i])
        return np.array(numbers, dtype=np.uint64)


def labelled_shingles(a: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the shingles of a sequence of word hashes, told apart by occurrence number."""
    if not len(a):
        return np.empty(0, dtype=np.uint64)
    size = min(words, len(a))
    n = len(a) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * _STEP + a[i : i + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.arange(n)
    h[order] = s + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _STEP
    return h


def order_sketches(h: np.ndarray, sketches: int, picks: int) -> np.ndarray:
    """One key per sketch from the smallest labelled shingles, kept in text order."""
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * _STEP)
    if len(h) > picks:
        g = (h[None, :] ^ seeds[:, None]) * _MIX_A
        g ^= g >> np.uint64(32)
        g *= _MIX_B
        chosen = h[np.sort(np.argpartition(g, picks - 1, axis=1)[:, :picks], axis=1)]
    else:
        chosen = np.broadcast_to(h, (sketches, len(h)))
    key = seeds.copy()
    for i in range(chosen.shape[1]):
        key = _mix(key + chosen[:, i])
    return key.view(np.int64)


def common_in_order(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of pairs with positions at most ``band`` apart.

    Bit k of ``row`` stands for position j - band + k of ``a`` at word j of ``b``, and is 0 where the
    length grows. Words of many positions hold them as one integer, the others as a list.
    """
    places: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    many = max(64, len(a) // 1024)
    masks: dict[int, int] = {}
    for x, at in places.items():
        if len(at) > many:
            bits = np.zeros(len(a), dtype=np.uint8)
            bits[at] = 1
            masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    row, left = full, 0
    for j, x in enumerate(b):
        left += not row & 1
        row = row >> 1 | top
        low = j - band
        if x in masks:
            match = (masks[x] >> low if low >= 0 else masks[x] << -low) & full
        else:
            match = 0
            for i in places.get(x, ()):
                if low <= i <= j + band:
                    match |= 1 << (i - low)
        hit = row & match
        if hit:
            row = (row + hit | row - hit) & full
    return left + width - row.bit_count()


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Order-keeping similarity of two sequences of word hashes, 0 if it can't reach the threshold."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < threshold * max(na, nb):
        return 0.0
    need = threshold / (1 + threshold) * (na + nb) - 1e-9
    low = min(na, nb)
    differ = np.flatnonzero(a[:low] != b[:low])
    head = int(differ[0]) if len(differ) else low
    low -= head
    differ = np.flatnonzero(a[na - low :][::-1] != b[nb - low :][::-1])
    tail = int(differ[0]) if len(differ) else low
    a, b = a[head : na - tail], b[head : nb - tail]
    common = head + tail
    if len(a) and len(b):
        (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if common + np.minimum(m[i], n[j]).sum() < need:
            return 0.0
        band = int((na + nb) * (1 - threshold) / (1 + threshold))
        common += common_in_order(a.tolist(), b.tolist(), min(band, max(len(a), len(b))))
    return common / (na + nb - common) if common >= need else 0.0


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=kind)


def _sketch(words: int, sketches: int, picks: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHasher()
        for batch in batches:
            sizes, keys = [], []
            for text in byte_texts(batch.column(1)):
                a = hashes(text)
                h = labelled_shingles(a, words)
                sizes.append(len(a))
                keys.append(order_sketches(h, sketches, picks) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), _lists(keys, schema.field(3).type)], schema=schema)

    return run


def _sequences(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHasher()
        for batch in batches:
            found = [hashes(t) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, schema.field(1).type)], schema=schema)

    return run


def _shingles(words: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled_shingles(x.values.to_numpy().view(np.uint64), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, schema.field(1).type)], schema=schema)

    return run


def _align(threshold: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            alike = [alignment_similarity(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), threshold) for a, b in pairs]
            keep = pa.array([x >= threshold for x in alike], pa.bool_())
            kept = [batch.column(0), batch.column(1), pa.array(alike, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in kept], schema=schema)

    return run


def _verified(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the threshold, with their similarity."""
    left = sequences.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = sequences.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ha", "hb")
    schema = pairs.sparkSession.createDataFrame([], "a binary, b binary, similarity double").schema
    return both.mapInArrow(_align(threshold, to_arrow_schema(schema)), schema)


def _sequences_of(documents: DataFrame, nodes: DataFrame, broadcast_nodes: int) -> DataFrame:
    """Word hashes in order of the texts with these digests, one row per text."""
    small = nodes.count() <= broadcast_nodes
    wanted = nodes.select(F.col("node").alias("digest"), "doc_id")
    # a text is taken from the row with its smallest id, so copies are not read again
    rows = documents.join(F.broadcast(wanted) if small else wanted, (documents["doc_id"].eqNullSafe(wanted["doc_id"])) & (documents["digest"] == wanted["digest"]), "left_semi")
    schema = documents.sparkSession.createDataFrame([], "node binary, h array<bigint>").schema
    return spool(rows.select("digest", "text").mapInArrow(_sequences(to_arrow_schema(schema)), schema).dropDuplicates(["node"]), "sequences")


def near_duplicates(documents: DataFrame, threshold: float = 0.8, words: int = 5, sketches: int = 16, picks: int = 2, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, digest of the text, cluster_id (smallest id of the class), kept, wordless."""
    spark = documents.sparkSession
    docs = text_rows(documents, "doc_id", "text", text_digest("text").alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = spark.createDataFrame([], f"doc_id {kind}, digest binary, n int, keys array<bigint>").schema
    rows = spool(docs.mapInArrow(_sketch(words, sketches, picks, to_arrow_schema(schema)), schema), "sketches")
    nodes = rows.where("n > 0").groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = spool(nodes, "nodes")
    members = nodes.select("node", "n", F.posexplode("keys").alias("sketch", "key"))
    # one leader per bucket, another in each sketch; buckets of one node fall away
    order = F.struct(F.xxhash64("node", "key").alias("r"), "node", "n")
    heads = members.groupBy("sketch", "key").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
    heads = heads.select("sketch", "key", "m", F.col("head.node").alias("leader"), F.col("head.n").alias("leader_n"))
    # buckets that hold a large share of the rows are joined without moving their members
    shared = spool(join_key_values(members, heads, ["sketch", "key"], "m"), "buckets")
    # the text that others are copies of shares most buckets with most of them
    degree = shared.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    central = F.max(F.struct("d", "node", "n")).alias("hub")
    hubs = shared.select("sketch", "key", "m", "node", "n").join(degree, "node").groupBy("sketch", "key", "m").agg(central)
    hubs = hubs.select("sketch", "key", "m", F.col("hub.node").alias("leader"), F.col("hub.n").alias("leader_n"))
    to_hub = join_key_values(shared.select("sketch", "key", "node", "n"), hubs, ["sketch", "key"], "m")
    fits = (F.col("node") != F.col("leader")) & (F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n"))
    ends = (F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    stars = shared.where(fits).select(*ends).union(to_hub.where(fits).select(*ends)).distinct()
    involved = shared.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sequences = _sequences_of(docs, involved, broadcast_nodes)
    links = spool(_verified(stars, sequences, threshold).select("a", "b"), "stars")
    labels = components(links)
    more = spool(_verified(_open_pairs(shared, labels, sequences, threshold, words), sequences, threshold).select("a", "b"), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("first")
    classes = named.groupBy("label").agg(first).select("label", F.col("first.doc_id").alias("cluster_id"), F.col("first.node").alias("stays"))
    named = spool(named.join(classes, "label").select("node", "doc_id", "cluster_id", (F.col("node") == F.col("stays")).alias("stays")), "classes")
    named = named.withColumnRenamed("doc_id", "least")
    out = rows.select("doc_id", "digest", "n").join(named, F.col("digest") == F.col("node"), "left")
    worded = F.col("n") > 0
    return out.select(
        "doc_id", "digest", F.when(worded, F.col("cluster_id")).otherwise(F.col("doc_id")).alias("cluster_id"),
        F.when(worded, F.col("stays") & F.col("doc_id").eqNullSafe(F.col("least"))).otherwise(F.lit(True)).alias("kept"), (~worded).alias("wordless"),
    )


def _open_pairs(shared: DataFrame, labels: DataFrame, sequences: DataFrame, threshold: float, words: int) -> DataFrame:
    """Pairs of different classes within buckets that hold several, that can reach the threshold.

    The largest class of a shingle meets the rows of the others only, so a class isn't paired out.
    Overlap of a and b must be at least t/(1+t) (na + nb). With shingles in one order by rarity, the
    first common shingle of such a pair lies among the first n - ceil(t n) + 1 of each, and what
    follows it on both sides must still suffice.
    """
    tagged = shared.select("sketch", "key", "m", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = tagged.groupBy("sketch", "key", "m").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("sketch", "key", "m")
    wanted = spool(join_key_values(tagged.drop("m"), mixed, ["sketch", "key"], "m").select("node", "label").distinct(), "open")

    cut = sequences.join(wanted.select("node"), "node").select("node", "h").mapInArrow(_shingles(words, to_arrow_schema(sequences.schema)), sequences.schema)
    entries = spool(cut.select("node", F.size("h").alias("n"), F.explode("h").alias("shingle")), "entries")
    counts = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one node only come first in the order and match nothing: their number is enough
    common = entries.join(counts, "shingle")
    of_node = Window.partitionBy("node")
    at = F.col("n") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("df", "shingle")) - 1
    heads = common.select("node", "n", "shingle", at.cast("int").alias("at")).where(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")))
    heads = spool(heads.join(wanted, "node"), "prefixes")
    sizes = heads.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    heads = spool(heads.join(largest.select("shingle", F.col("top.label").alias("top")), "shingle"), "mixed")
    other = heads.drop("top").withColumnsRenamed({c: f"o_{c}" for c in ("shingle", "node", "label", "n", "at")})
    need = threshold / (1 + threshold) * (F.col("n") + F.col("o_n"))
    able = (F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) >= need) & (F.least("n", "o_n") >= threshold * F.greatest("n", "o_n"))
    few = heads.where("label <> top")
    once = (F.col("o_label") == F.col("top")) | (F.col("node") < F.col("o_node"))
    pairs = few.join(other, (few["shingle"] == other["o_shingle"]) & (F.col("label") != F.col("o_label")) & once & able)
    return pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def duplicate_classes(documents: DataFrame) -> DataFrame:
    """doc_id, cluster_id and whether the row is the one that stays of its class."""
    return near_duplicates(documents).select("doc_id", "cluster_id", "kept")


def without_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each class of documents, with all its columns; wordless rows all stay."""
    found = spool(near_duplicates(documents), "kept")
    digest = text_digest("text")

    def keys(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias(k_id), F.col("digest").alias(k_digest)).distinct()

    k_id, k_digest = free_names(documents, "_k_id", "_k_digest")
    same = documents["doc_id"].eqNullSafe(F.col(k_id)) & (digest == F.col(k_digest))
    # rows that agree in id and text: all but one of them go, too
    twins = keys(found.where("kept and not wordless").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    gone = keys(found.where("not kept"))
    if twins.isEmpty():
        return documents.join(gone, same, "left_anti")
    one = documents.join(twins, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return documents.join(gone.union(twins), same, "left_anti").unionByName(one)
