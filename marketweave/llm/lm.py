"""Language-model scores: an interpolated modified Kneser-Ney model of order two, in hash shards.

Tokens are the words of the text with A-Z in lower case and one end; the first word follows a
start that is no token. With c the counts of the training texts, D the Chen-Goodman discounts,
N1+(.w) the distinct predecessors of w:

    p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p1(w),    p(w|v) = p1(w) if c(v) = 0
    p1(w)  = max(N1+(.w) - D'(N1+(.w)), 0) / N1+(..) + g' / (V + 1)

The model grows with the corpus, so no worker holds all of it. It lives in shards by word hash:

1. The documents are read once, in chunks of at most ``chunk_bytes`` of text. A chunk sends each
   shard the words and bigrams that it needs, once each, with their training counts, and keeps its
   texts as word numbers.
2. A shard adds the counts up into sorted hash arrays, which it memory-maps, and looks every
   request up there: counts of bigrams and words, continuations by count. It passes the number of
   distinct predecessors of words on to the shards of those words.
3. Those add the predecessors up and answer the same word lists.
4. A chunk meets its answers again and sums log10 p over the tokens of each text.

Words are told apart by 64 bits where they are counted, by 40 bits as second word of a bigram.
A frequent word costs one row per chunk and shard, however often it occurs.

Edge cases: null and empty texts are the end alone; rows with equal ids are scored one by one; with
no training text, unknown tokens share the uniform probability 1/(V+1); a chunk holds at least one
text, so the longest text bounds the memory of a task; other columns are ignored. A task that runs
again must read its rows in the same order, as from files; otherwise the run fails and gives no scores.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import byte_texts, fold_of, pack, spool, text_rows, unpack

# no token holds a blank, so these are no words
END, START = b" end", b" start"
_LOW = np.uint64((1 << 40) - 1)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MESSAGE = "kind string, chunk string, shard int, data binary, doc_ids array<{id}>, held array<boolean>"


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def five_bytes(x: np.ndarray) -> np.ndarray:
    """40-bit numbers as rows of five bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :5]) if len(x) else np.empty((0, 5), np.uint8)


def from_five(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), 8), dtype=np.uint8)
    wide[:, :5] = x
    return wide.view("<u8").ravel()


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped file that has no name any more, so nothing stays behind."""
    if not array.nbytes:
        return array
    with tempfile.TemporaryFile() as f:
        f.write(np.ascontiguousarray(array).data)
        f.flush()
        return np.memmap(f, dtype=array.dtype, mode="r", shape=array.shape)


def order_of(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, and the order of the words by (shard, hash); the shard of a hash is its low 40 bits."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    shard = (hashes & _LOW) % np.uint64(shards)
    return hashes, shard, np.lexsort((hashes, shard))


def bigram_keys(numbers: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """(previous, current) of every token as one number."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[starts] = start
    return (before << np.uint64(32)) | numbers


class Chunk:
    """Texts that are asked for together. The name joins them with the answers of all shards, so a
    task that runs again gives it again: place of the chunk in its partition and hash of its rows."""

    def __init__(self, partition: int, number: int):
        self.place = f"{partition}-{number}"
        self.rows = xxhash.xxh3_128()
        self.ids: dict[bytes, int] = {END: 0, START: 1}
        self.tokens: list[np.ndarray] = []
        self.doc_ids: list = []
        self.held: list[bool] = []
        self.size = 0

    def add(self, doc_id, text: bytes, held: bool) -> None:
        ids = self.ids
        words = tokens_of(text)
        numbers = [ids.get(w, -1) for w in words]
        for i, x in enumerate(numbers):
            if x < 0:
                numbers[i] = ids.setdefault(words[i], len(ids))
        numbers.append(0)
        self.tokens.append(np.array(numbers, dtype=np.uint32))
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.size += len(text) + 1
        self.rows.update(f"{doc_id!r} {held} {len(text)} ".encode())
        self.rows.update(text)

    def messages(self, shards: int) -> Iterator[tuple]:
        chunk = f"{self.place}-{self.rows.hexdigest()}"
        lengths = np.array([len(t) for t in self.tokens], dtype=np.uint32)
        tokens = np.concatenate(self.tokens)
        words = list(self.ids)
        self.ids, self.tokens = {}, []
        hashes, shard, order = order_of(words, shards)
        del words
        place = np.empty(len(order), dtype=np.uint32)  # number of a word in the order of the answers
        place[order] = np.arange(len(order), dtype=np.uint32)
        often = np.argsort(-np.bincount(tokens, minlength=len(order)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[often] = np.arange(len(order), dtype=np.uint32)
        yield ("body", chunk, -1, pack(rank[tokens], place[often].astype(np.uint32), lengths, np.array([place[1]], dtype=np.uint32)), self.doc_ids, self.held)
        numbers = place[tokens].astype(np.uint64)
        del tokens, rank, often
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        learnt = np.repeat(~np.array(self.held, dtype=bool), lengths)
        keys, inverse = np.unique(bigram_keys(numbers, starts, int(place[1])), return_inverse=True)
        count = np.bincount(inverse[learnt], minlength=len(keys)).astype(np.uint32)
        del inverse
        own = np.bincount(numbers[learnt].astype(np.int64), minlength=len(order)).astype(np.uint32)
        own[place[1]] = int((~np.array(self.held, dtype=bool)).sum())
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        hashes = hashes[order]
        low = five_bytes((hashes & _LOW)[second])
        degree = np.bincount(first, minlength=len(order)).astype(np.uint32)
        edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        cuts = np.concatenate(([0], np.cumsum(degree.astype(np.int64))))
        for s in np.flatnonzero(np.diff(edges)).tolist():  # at most one message a word, however many shards
            a, b = int(edges[s]), int(edges[s + 1])
            x, y = int(cuts[a]), int(cuts[b])
            yield ("request", chunk, s, pack(hashes[a:b], own[a:b], degree[a:b], low[x:y].reshape(-1), count[x:y]), None, None)


def _read(shards: int, chunk_bytes: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition, number = context.partitionId() if context else 0, 0
        chunk = Chunk(partition, number)
        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                chunk.add(doc_id, text, held)
                if chunk.size >= chunk_bytes:
                    yield from _rows(chunk.messages(shards), schema)
                    number += 1
                    chunk = Chunk(partition, number)
        if chunk.doc_ids:
            yield from _rows(chunk.messages(shards), schema)

    return run


def _rows(messages: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for m in messages:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(m, schema, strict=True)], schema=schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "data", "doc_ids", "held"])


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def count_shard(shards: int):
    """Step 2: requests of one shard -> answers, predecessors for other shards, word lists, totals."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pdf.drop(columns="sub")
        shard = int(key[0])
        parts = [unpack(d) for d in pdf["data"]]
        chunks = list(pdf["chunk"])
        words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.uint64)
        spots = np.split(which.astype(np.int64), np.cumsum([len(p[0]) for p in parts])[:-1])
        keys = []
        for p, at in zip(parts, spots, strict=True):
            low = from_five(p[3].reshape(-1, 5))
            keys.append((np.repeat(at, p[2]).astype(np.uint64) << np.uint64(40)) | low)
        learnt = np.concatenate([k[p[4] > 0] for k, p in zip(keys, parts, strict=True)])
        weight = np.concatenate([p[4][p[4] > 0] for p in parts])
        order = np.argsort(learnt, kind="stable")
        learnt, weight = learnt[order], weight[order]
        edge = np.flatnonzero(np.concatenate(([True], learnt[1:] != learnt[:-1]))) if len(learnt) else np.empty(0, np.int64)
        total = np.add.reduceat(weight, edge).astype(np.uint32) if len(edge) else np.empty(0, np.uint32)
        table, totals = mapped(learnt[edge]), mapped(total)
        del learnt, weight, order
        first = (table >> np.uint64(40)).astype(np.int64)
        by_count = [np.bincount(first[np.minimum(totals, 3) == k], minlength=len(words)).astype(np.uint32) for k in (1, 2, 3)]
        out = []
        for chunk, p, at, k in zip(chunks, parts, spots, keys, strict=True):
            spot = np.minimum(np.searchsorted(table, k), max(len(table) - 1, 0))
            found = np.where(table[spot] == k, totals[spot], 0).astype(np.uint32) if len(table) else np.zeros(len(k), np.uint32)
            out.append(("counts", chunk, shard, pack(count[at], *(n[at] for n in by_count), found), None, None))
            out.append(("list", chunk, shard, pack(np.diff(np.sort(at), prepend=0).astype(np.uint32)), None, None))
        out.append(("words", None, shard, pack(words & _LOW), None, None))
        second, before = np.unique(table & _LOW, return_counts=True)
        # one sort by target, cut at its edges: the work doesn't grow with the number of shards
        to = second % np.uint64(shards)
        order = np.argsort(to, kind="stable")
        to, second, before = to[order], five_bytes(second[order]), before[order].astype(np.uint32)
        targets, cuts = np.unique(to, return_index=True)
        for s, a, b in zip(targets.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=True):
            out.append(("before", None, int(s), pack(second[a:b].reshape(-1), before[a:b]), None, None))
        start = xxhash.xxh3_64_intdigest(START)
        tokens = count[words != np.uint64(start)]
        numbers = [int(tokens.sum()), int((tokens > 0).sum()), *_tally(totals)]
        out.append(("totals", None, shard, np.array(numbers, dtype="<i8").tobytes(), None, None))
        return _frame(out)

    return run


def continue_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 3: distinct predecessors of the words of one shard, for every list of words."""
    own = unpack(pdf.loc[pdf["kind"] == "words", "data"].iloc[0])[0]
    parts = [unpack(d) for d in pdf.loc[pdf["kind"] == "before", "data"]]
    names = np.concatenate([np.empty(0, np.uint64), *(from_five(p[0].reshape(-1, 5)) for p in parts)])
    seconds, which = np.unique(names, return_inverse=True)
    before = np.bincount(which, weights=np.concatenate([np.empty(0), *(p[1] for p in parts)]), minlength=len(seconds)).astype(np.uint32)
    spot = np.minimum(np.searchsorted(seconds, own), max(len(seconds) - 1, 0))
    found = np.where(seconds[spot] == own, before[spot], 0).astype(np.uint32) if len(seconds) else np.zeros(len(own), np.uint32)
    out = []
    lists = pdf[pdf["kind"] == "list"]
    for chunk, data in zip(lists["chunk"], lists["data"], strict=True):
        out.append(("before", chunk, int(key[0]), pack(found[np.cumsum(unpack(data)[0].astype(np.int64))]), None, None))
    out.append(("totals", None, int(key[0]), np.array([int(before.sum()), *_tally(before), int((before > 2).sum())], dtype="<i8").tobytes(), None, None))
    return _frame(out)


def discounts(n: list[int]) -> np.ndarray:
    """Chen-Goodman discounts for counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1))])


def score_chunk(n: int, v: int, bigrams: list[int], pairs: int, before: list[int]):
    """Step 4. n, v: tokens and distinct tokens; pairs: distinct bigrams; counts of counts of both."""
    d2, d1 = discounts(bigrams), discounts(before[:4])
    # what the discounts take from the words, by one, two, three or more predecessors
    rest = float((d1[1:] * [before[0], before[1], before[4]]).sum())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = pdf[pdf["kind"] == "body"]
        if len(bodies) != 1:
            raise RuntimeError(f"chunk {key[0]}: {len(bodies)} bodies; the rows of documents changed their order when a task ran again")
        body = bodies.iloc[0]
        ranks, places, lengths, start = unpack(body["data"])
        counts = [unpack(x) for x in pdf[pdf["kind"] == "counts"].sort_values("shard")["data"]]
        count, one, two, more, pair = (np.concatenate([c[i] for c in counts]) for i in range(5))
        prior = np.concatenate([unpack(x)[0] for x in pdf[pdf["kind"] == "before"].sort_values("shard")["data"]])
        if not len(count) == len(prior) == len(places):
            raise RuntimeError(f"chunk {key[0]}: answers for {len(count)} and {len(prior)} of {len(places)} words")
        numbers = places[ranks].astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        keys = bigram_keys(numbers, starts, int(start[0]))
        _, which = np.unique(keys, return_inverse=True)
        seen = pair[which]
        del which
        first, second = (keys >> np.uint64(32)).astype(np.int32), numbers.astype(np.int32)
        del keys, numbers
        kept = np.maximum(prior - d1[np.minimum(prior, 3)], 0)
        uniform = 1.0 / (v + 1)
        low = kept / pairs + (rest / pairs) * uniform if pairs else np.full(len(prior), uniform)
        context = count.astype(float)
        gap = d2[1] * one + d2[2] * two + d2[3] * more
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(context > 0, gap / context, 1.0)
            logs = np.maximum(seen - d2[np.minimum(seen, 3)], 0) / context[first]
        logs[context[first] == 0] = 0.0
        logs += back[first] * low[second]
        np.log10(logs, out=logs)
        base = np.log10((count + 1.0) / (n + v + 1.0))[second]
        return pd.DataFrame({
            "doc_id": list(body["doc_ids"]), "held_out": list(body["held"]), "n_tokens": lengths.astype(np.int64),
            "n_known": np.add.reduceat((count > 0)[second].astype(np.int64), starts), "train_tokens": n,
            "base_score": np.add.reduceat(base, starts), "score": (score := np.add.reduceat(logs, starts)), "perplexity": 10.0 ** (-score / lengths),
        })

    return run


def scores(documents: DataFrame, folds: int = 7, held_out: int = 2, chunk_bytes: int = 12_000_000, shard_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity per token of every row."""
    spark = documents.sparkSession
    docs = text_rows(documents, "doc_id", "text", (fold_of("doc_id", folds) == held_out).alias("held"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = max(1, -(-int(size or 0) // shard_bytes))
    message = MESSAGE.format(id=kind)
    schema = spark.createDataFrame([], message).schema
    sent = docs.mapInArrow(_read(shards, chunk_bytes, to_arrow_schema(schema)), schema)
    keyed = sent.withColumn("sub", F.when(F.col("shard") < 0, F.col("chunk")).otherwise(F.lit("")))
    counted = spool(keyed.groupBy("shard", "sub").applyInPandas(count_shard(shards), message), "counts")
    asked = counted.where(F.col("kind").isin("words", "list", "before"))
    continued = spool(asked.groupBy("shard").applyInPandas(continue_shard, message), "continuations")
    sums = np.zeros(6, dtype=np.int64)
    for r in counted.where("kind = 'totals'").select("data").collect():  # one short row a shard
        sums += np.frombuffer(r["data"], "<i8")
    ahead = np.zeros(6, dtype=np.int64)
    for r in continued.where("kind = 'totals'").select("data").collect():
        ahead += np.frombuffer(r["data"], "<i8")
    n, v, pairs = int(sums[0]), int(sums[1]), int(ahead[0])
    score = score_chunk(n, v, sums[2:].tolist(), pairs, ahead[1:].tolist())
    parts = counted.where(F.col("kind").isin("body", "counts")).union(continued.where("kind = 'before'"))
    return parts.groupBy("chunk").applyInPandas(score, result)
