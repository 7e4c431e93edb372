"""Packing along a space-filling curve.

Each document becomes token ids and one closing id. Its hashed token counts are projected to three
numbers, standardised over all documents and placed on a Hilbert curve. Rows are range-partitioned
and sorted by their place on the curve (ties, such as copies, by a hash of the id, so that a large
group of equal documents spreads over several ranges), and the documents of each range are laid end
to end into sequences of ``length`` ids, cut where a sequence is full. Only the last sequence of a
range has padding.

Ids are those of the ``tokenizers`` library with the given vocabulary and no special tokens added.
A rank-based encoder of the same vocabulary is several times faster and used for texts in which
both agree: no special token and only characters whose classes are stable.

Edge cases: null and empty texts are the closing id alone; rows with equal ids are packed one by
one; a long document fills several sequences; other columns are ignored. One document's ids and one
sequence is what a task holds beside its batch.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import plain_texts, spool, text_rows

BUCKETS = 256
DIMENSIONS = 3
BITS = 10
#: Beyond these characters the two encoders may class a character differently.
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-ſ]")
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None, ranks: str | None = None):
    """encode(text) -> ids. Paths: the vocabulary and the same vocabulary as ranks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if _UNSAFE.search(text) or any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20).normal(size=(BUCKETS, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """Three coordinates of the hashed token counts, scaled to unit length."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    v = np.sqrt(np.bincount(hashed.astype(np.int64), minlength=BUCKETS))
    return (v / max(np.linalg.norm(v), 1e-12)) @ _projection()


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the sub-cubes, coarse to fine
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code across the coordinates
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenise(vocabulary: str | None, ranks: str | None, closing: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            ids, counts, places = [], [], []
            for text in plain_texts(batch.column(1)):
                tokens = np.array([*encode(text), closing], dtype="<u4")
                counts.append(len(tokens))
                places.append(project(tokens))
                ids.append((tokens.astype("<u2") if tokens.max() < 65536 else tokens).tobytes())
            p = np.array(places).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(p[:, i]) for i in range(DIMENSIONS)), pa.array(ids, pa.binary())], schema=schema
            )

    return run


def _pack(length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        used = 0
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = data.as_py()
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    take = min(n - at, length - used)
                    rows.append((doc_id, at, take, ids[at : at + take].tobytes(), n, sequence, used))
                    at += take
                    used += take
                    if used == length:
                        sequence, used = sequence + 1, 0
                if len(rows) >= 4096:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(documents: DataFrame, length: int = 1024, closing: int = 0, vocabulary: str | None = None, ranks: str | None = None, tokens_per_task: int = 8_000_000) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    docs = text_rows(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p{i}" for i in range(DIMENSIONS)]
    schema = spark.createDataFrame([], f"doc_id {kind}, n long, {', '.join(f'{p} double' for p in names)}, ids binary").schema
    rows = spool(docs.mapInArrow(_tokenise(vocabulary, ranks, closing, to_arrow_schema(schema)), schema), "tokens")
    stats = rows.agg(F.sum("n").alias("n"), *(f(p).alias(f"{f.__name__}_{p}") for p in names for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([stats[f"avg_{p}"] or 0.0 for p in names])
    scale = np.array([stats[f"stddev_pop_{p}"] or 1.0 for p in names])

    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        z = (np.column_stack((a, b, c)) - mean) / scale
        cells = np.floor((1 << BITS) / (1 + np.exp(-1.7 * np.clip(z, -30, 30)))).astype(np.int64)
        return pd.Series(hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1)))

    parts = max(1, -(-int(stats["n"] or 0) // tokens_per_task))
    keyed = rows.select("doc_id", "n", "ids", place(*names).alias("key"), F.xxhash64("doc_id", "n").alias("tie"))
    along = keyed.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "doc_id").select("doc_id", "n", "ids")
    out = spark.createDataFrame([], f"doc_id {kind}, {PIECE}").schema
    return along.mapInArrow(_pack(length, to_arrow_schema(out)), out)


def packing_report(documents: DataFrame) -> DataFrame:
    """The pieces of packed() with the crc32 of their ids."""
    pieces = packed(documents)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
