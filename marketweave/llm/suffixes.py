"""Repeated substrings of a corpus: maximal repeats from the interval trees of enhanced suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (smaller id, or
same text and smaller offset); the earliest occurrence stays.

Suffixes are dealt to tasks by content, so that equal strings of ``length`` bytes meet:

1. *Zones.* Each window of ``length`` bytes has an anchor, its ``gram``-byte string of the smallest
   hash. Consecutive windows with one anchor are a zone. Both depend on the window's bytes alone, so
   equal windows have equal anchors, and equal zones are recognised by 128 bits. Within a chunk of
   documents only the first of equal zones is sent on.
2. *Classes.* Zones meet by anchor. All but the first of equal zones go. The first ones of an anchor
   that stands in different surroundings may still share windows: they are checked.
3. *Suffix arrays.* The texts with zones to check send those strings to tasks by anchor. A task sorts
   the suffixes, scans the common prefixes with a stack into the tree of common-prefix intervals, and
   keeps the intervals of at least ``length`` that are left-diverse: the maximal repeats, each with
   all its occurrences. All but the first occurrence go.

An anchor with very many surroundings (a passage in a large part of the corpus, estimated on a hash
sample of 1/``sample`` of the texts) is not kept together: its zones are cut into single windows,
which are dealt out by their own bytes. This changes the routing, never the result.

Edge cases: null is the empty text; texts shorter than ``length`` lose nothing; matches never cross
texts; rows that repeat id and text are one document and get the same result; different texts under
one id are ordered by digest; a null id comes first; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import byte_texts, pack, spool, text_digest, text_rows, unpack

_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: one zone of a document: offset of its first window, windows, whether it is to be checked
MARK = "doc_id long, tie long, start int, n int, anchor long, gone boolean"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` bytes (a power of two), by doubling."""
    h, step = _TABLE[data], 1
    with np.errstate(over="ignore"):
        m = _STEP
        while step < gram:
            h = h[:-step] * m + h[step:]
            m = m * m
            step *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def zones_of(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the zones of one text, their numbers of windows and the hashes of their anchors."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if width > step:
        m = np.minimum(m[: -(width - step)], m[width - step :])
    anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return starts, np.diff(np.append(starts, len(anchor))), h[anchor[starts]]


def cut_hot(data: bytes, starts, counts, anchors, hot: np.ndarray, length: int):
    """Zones of hot anchors become single windows, whose anchor is the hash of all their bytes."""
    if not len(hot) or not len(starts):
        return starts, counts, anchors
    is_hot = hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors
    if not is_hot.any():
        return starts, counts, anchors
    parts = [np.arange(s, s + n) for s, n in zip(starts[is_hot].tolist(), counts[is_hot].tolist(), strict=True)]
    single = np.concatenate(parts)
    hashed = np.array([xxhash.xxh3_64_intdigest(data[s : s + length], seed=3) for s in single.tolist()], dtype=np.uint64)
    return (
        np.concatenate((starts[~is_hot], single)), np.concatenate((counts[~is_hot], np.ones(len(single), np.int64))), np.concatenate((anchors[~is_hot], hashed)),
    )


def suffix_intervals(strings: list[bytes], counts: list[int], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats of at least ``length`` among the suffixes that start in the first counts[i]
    bytes of strings[i]: (common length, numbers of the suffixes), shortest last in each subtree.

    A suffix at the front of its string counts as left-diverse: what precedes it is not known.
    """
    n = sum(counts)
    if n < 2:
        return
    widest = max(map(len, strings))
    flat = np.frombuffer(b"".join(strings) + bytes(widest + 1), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    counts_ = np.array(counts, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(n) - np.repeat(np.concatenate(([0], np.cumsum(counts_)[:-1])), counts_)
    at = np.repeat(first, counts_) + inside
    room = np.repeat(lengths, counts_) - inside
    rows = np.lib.stride_tricks.sliding_window_view(flat, widest)[at]
    rows[np.arange(widest)[None, :] >= room[:, None]] = 0
    order = np.argsort(rows.view(f"S{widest}").ravel(), kind="stable")
    left = np.where(inside > 0, flat[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(n))
    rows, room_ = rows[order], room[order]
    lcp = np.zeros(n + 1, dtype=np.int64)  # of neighbours i-1 and i; 0 at both ends
    block = 65536
    for a in range(1, n, block):
        b = min(a + block, n)
        differ = rows[a:b] != rows[a - 1 : b - 1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
        lcp[a:b] = np.minimum(common, np.minimum(room_[a:b], room_[a - 1 : b - 1]))
    del rows
    lcp[lcp < length] = 0
    left = left[order]
    # only stretches with common prefixes can hold intervals
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (lcp > 0).view(np.int8), [0]))))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if int(lcp[lo:hi].min()) == int(lcp[lo:hi].max()):  # one interval
            found = [(int(lcp[lo]), lo - 1, hi - 1)]
        else:
            found, stack = [], []  # stack: (common length, left end)
            for i in range(lo, hi + 1):
                value = int(lcp[i]) if i < hi else 0
                begin = i - 1
                while stack and stack[-1][0] > value:
                    size, begin = stack.pop()
                    found.append((size, begin, i - 1))
                if value and (not stack or stack[-1][0] < value):
                    stack.append((value, begin))
        for size, a, b in found:
            before = left[a : b + 1]
            if before[0] < 0 or (before != before[0]).any():
                yield size, order[a : b + 1]


def _chunks(length: int, gram: int, hot, shards: int, chunk_bytes: int, schema: pa.Schema):
    """Step 1: one message per chunk and shard, and the zones that repeat inside the chunk."""

    def flush(docs: list[tuple], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        doc = np.concatenate([np.full(len(p[0]), p[4], np.int64) for p in parts])
        start, n, anchor, zone = (np.concatenate([p[i] for p in parts]) for i in range(4))
        ids, ties = (np.array([d[i] for d in docs], dtype=np.int64) for i in (0, 1))
        order = np.lexsort((start, ties[doc], ids[doc], zone, anchor))
        doc, start, n, anchor, zone = doc[order], start[order], n[order], anchor[order], zone[order]
        new, gone = _first_of_equals(anchor, zone, ids[doc], ties[doc], start)
        # one sort by shard, cut at its edges: the work doesn't grow with the number of shards
        shard = anchor % np.uint64(shards)
        opens, later = np.flatnonzero(new), np.flatnonzero(gone)
        opens = opens[np.lexsort((start[opens], doc[opens], shard[opens]))]
        later = later[np.argsort(shard[later], kind="stable")]
        present = np.union1d(shard[opens], shard[later])
        edges = [np.searchsorted(shard[x], present, side) for x in (opens, later) for side in ("left", "right")]
        for s, a, b, c, d in zip(present.tolist(), *(e.tolist() for e in edges), strict=True):
            sent, lost = opens[a:b], later[c:d]
            used, place = np.unique(np.concatenate((doc[sent], doc[lost])), return_inverse=True)
            message = [ids[used], ties[used], anchor[sent], zone[sent], place[: len(sent)].astype(np.uint32), start[sent].astype(np.uint32), n[sent].astype(np.uint8)]
            message += [place[len(sent) :].astype(np.uint32), start[lost].astype(np.uint32), n[lost].astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(*message)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, size = [], [], 0
        for batch in batches:
            for doc_id, text, tie in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                zone = cut_hot(text, *zones_of(text, length, gram), hot.value, length)
                if len(zone[0]):
                    spans = zip(zone[0].tolist(), (zone[0] + zone[1] + length - 1).tolist(), strict=True)
                    hashed = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in spans), np.uint64, len(zone[0]))
                    parts.append((zone[0], zone[1], zone[2], hashed, len(docs)))
                    docs.append((_id(doc_id), tie))
                size += len(text)
                if size >= chunk_bytes:
                    yield from flush(docs, parts)
                    docs, parts, size = [], [], 0
        yield from flush(docs, parts)

    return run


def _id(doc_id) -> int:
    return -(1 << 63) if doc_id is None else int(doc_id)


def _first_of_equals(anchor, zone, ids, ties, start) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: which open a class of equal zones, and which are later than the first."""
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (zone[1:] != zone[:-1])))
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = (ids == ids[head]) & (ties == ties[head]) & (start == start[head])  # the row repeated
    return new, ~new & ~same


def _classes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2: the zones of one shard -> those that go and those to be checked."""
    parts = [unpack(d) for d in pdf["data"]]
    ids, ties = (np.concatenate([p[i].view(np.int64)[p[4]] for p in parts]) for i in (0, 1))
    anchor, zone = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    start, n = np.concatenate([p[5] for p in parts]).astype(np.int64), np.concatenate([p[6] for p in parts])
    order = np.lexsort((start, ties, ids, zone, anchor))
    ids, ties, anchor, zone, start, n = (x[order] for x in (ids, ties, anchor, zone, start, n))
    if len(ids):
        new, gone = _first_of_equals(anchor, zone, ids, ties, start)
        apart = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(apart))
        check = new & (kinds[np.cumsum(apart) - 1] > 1)
    else:
        gone = check = np.zeros(0, dtype=bool)
    keep = gone | check
    lost = [(p[0].view(np.int64)[p[7]], p[1].view(np.int64)[p[7]], p[8], p[9]) for p in parts]
    more = [np.concatenate([x[i] for x in lost]) for i in range(4)]
    return pd.DataFrame({
        "doc_id": np.concatenate((ids[keep], more[0])), "tie": np.concatenate((ties[keep], more[1])),
        "start": np.concatenate((start[keep], more[2])).astype(np.int32), "n": np.concatenate((n[keep], more[3])).astype(np.int32),
        "anchor": np.concatenate((np.where(gone, 0, anchor.view(np.int64))[keep], np.zeros(len(more[0]), np.int64))),
        "gone": np.concatenate((gone[keep], np.ones(len(more[0]), dtype=bool))),
    })


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    starts, ends = merged_spans(starts, ends)
    digest, at = hashlib.sha256(), 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return len(text), int((ends - starts).sum()), len(starts), digest.hexdigest()


STATE = "doc_id {id}, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, gone binary, shard int"


def _ask(length: int, shards: int, schema: pa.Schema):
    """Texts with their marks -> finished rows; unfinished rows and strings of zones to check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            asked: dict[int, list] = {}
            for doc_id, tie, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), batch.column(3), strict=True):
                if not marks.is_valid:
                    none = np.empty(0, np.int64)
                    rows.append((doc_id, tie, *_result(text, none, none), None, None, None))
                    continue
                fields = marks.values
                start, n, anchor, gone = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                a, b = merged_spans(start[gone].astype(np.int64), (start + n + length - 1)[gone].astype(np.int64))
                if gone.all():
                    rows.append((doc_id, tie, *_result(text, a, b), None, None, None))
                    continue
                rows.append((doc_id, tie, None, None, None, None, zstandard.compress(text, 3), pack(a, b), None))
                for s, k, h in zip(start[~gone].tolist(), n[~gone].tolist(), anchor[~gone].tolist(), strict=True):
                    asked.setdefault((h & 0xFFFFFFFFFFFFFFFF) % shards, []).append((_id(doc_id), tie, s, k, text[s : s + k + length - 1]))
            for shard, zones in asked.items():
                ids, ties, starts, counts, strings = zip(*zones, strict=True)
                arrays = pack(np.array(ids, np.int64), np.array(ties, np.int64), np.array(starts, np.uint32), np.array(counts, np.uint8))
                body = zstandard.compress(b"".join(strings), 3)
                rows.append((None, None, None, None, None, None, body, arrays, shard))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _zone_strings(pdf: pd.DataFrame, length: int):
    ids, ties, starts, counts, strings = [], [], [], [], []
    for body, arrays in zip(pdf["text"], pdf["gone"], strict=True):
        i, t, s, c = unpack(arrays)
        text, at = zstandard.decompress(body), 0
        for k in c.tolist():
            strings.append(text[at : at + k + length - 1])
            at += k + length - 1
        ids.append(i.view(np.int64)), ties.append(t.view(np.int64)), starts.append(s.astype(np.int64)), counts.append(c.astype(np.int64))
    return (*(np.concatenate(x) for x in (ids, ties, starts, counts)), strings)


def _repeats(length: int):
    """Step 3: strings of one shard -> spans that go."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ties, starts, counts, strings = _zone_strings(pdf, length)
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        at = starts[owner] + inside
        _, rank = np.unique(np.stack((ids, ties), axis=1), axis=0, return_inverse=True)
        place = (rank.ravel()[owner].astype(np.int64) << 32) | at  # order of occurrences
        spots, sizes = [], []
        for size, members in suffix_intervals(strings, counts.tolist(), length):
            later = members[place[members] > place[members].min()]
            spots.append(later)
            sizes.append(np.full(len(later), size))
        spot = np.concatenate([np.empty(0, np.int64), *spots])
        size = np.concatenate([np.empty(0, np.int64), *sizes])
        # one row per document: the union of its spans, by document, start
        out = []
        if len(spot):
            doc = rank.ravel()[owner[spot]]
            order = np.argsort(doc, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                a, b = merged_spans(at[spot[part]], at[spot[part]] + size[part])
                one = owner[spot[part[0]]]
                out.append((ids[one], ties[one], pack(a, b)))
        return pd.DataFrame(out, columns=["doc_id", "tie", "spans"])

    return run


def _finish(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, packed, gone, more in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = zip(*(unpack(x) for x in [gone, *(more or [])]), strict=True)
                rows.append((doc_id, *_result(zstandard.decompress(packed), np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64))))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _hot_anchors(docs: DataFrame, length: int, gram: int, sample: int, hot_from: int) -> np.ndarray:
    """Anchors with about ``hot_from`` different surroundings or more, from a sample of the texts."""
    schema = pa.schema([("anchor", pa.int64()), ("around", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in byte_texts(batch.column(0)):
                start, n, anchor = zones_of(text, length, gram)
                found.update((h, xxhash.xxh3_64_intdigest(text[a : a + k + length - 1])) for a, k, h in zip(start.tolist(), n.tolist(), anchor.tolist(), strict=True))
            both = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    few = docs.where(F.pmod("tie", F.lit(sample)) == 0).select("text")
    counted = few.mapInArrow(run, "anchor long, around long").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("m"))
    # at most (zones of the sample) / (hot_from / sample) rows
    rows = counted.where(F.col("m") >= max(2, hot_from // sample)).select("anchor").collect()
    return np.array(sorted(r["anchor"] & 0xFFFFFFFFFFFFFFFF for r in rows), dtype=np.uint64)


def without_repeats(
    documents: DataFrame, length: int = 100, gram: int = 32, chunk_bytes: int = 32_000_000, shard_bytes: int = 40_000_000, check_zones: int = 4_000, sample: int = 64, hot_from: int = 4_000
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document row."""
    spark = documents.sparkSession
    docs = text_rows(documents, "doc_id", "text", F.xxhash64(text_digest("text")).alias("tie"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = max(1, -(-size // shard_bytes))
    hot = spark.sparkContext.broadcast(_hot_anchors(docs, length, gram, sample, hot_from))
    message = spark.createDataFrame([], "shard int, data binary").schema
    sent = docs.mapInArrow(_chunks(length, gram, hot, shards, chunk_bytes, to_arrow_schema(message)), message)
    marks = spool(sent.groupBy("shard").applyInPandas(_classes, MARK), "marks")
    # the marks of a document are bounded by its length
    by_doc = marks.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n", "anchor", "gone")).alias("marks"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "m_id", "tie": "m_tie"})
    texts = docs.select("doc_id", "tie", "text")
    joined = texts.join(by_doc, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("m_id")) & (F.col("tie") == F.col("m_tie")), "left")
    zones = max(1, marks.where("not gone").count())
    state = spark.createDataFrame([], STATE.format(id=kind)).schema
    asked = spool(joined.select("doc_id", "tie", "text", "marks").mapInArrow(_ask(length, -(-zones // check_zones), to_arrow_schema(state)), state), "asked")
    answers = asked.where("shard is not null").select("shard", "text", "gone").groupBy("shard").applyInPandas(_repeats(length), "doc_id long, tie long, spans binary")
    answers = answers.groupBy("doc_id", "tie").agg(F.collect_list("spans").alias("more")).withColumnsRenamed({"doc_id": "a_id", "tie": "a_tie"})
    out = spark.createDataFrame([], f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").schema
    open_rows = asked.where("shard is null and n_bytes is null").select("doc_id", "tie", "text", "gone")
    open_rows = open_rows.join(answers, (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("a_id")) & (F.col("tie") == F.col("a_tie")), "left")
    finished = open_rows.select("doc_id", "text", "gone", "more").mapInArrow(_finish(to_arrow_schema(out)), out)
    return asked.where("n_bytes is not null").select(*out.names).union(finished)
