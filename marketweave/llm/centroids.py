"""Centroid clustering: Lloyd's rounds with the dimensions dealt to shards, in exact integers.

Vectors become integers, floor(scale * x). They are written once in cells of ``cell_rows`` rows by
``block_columns`` columns. A cell task knows only the slices of the centroids for its own columns
and computes its exact part of every squared distance; parts of one group of rows are added and the
smallest sum names the cluster. The labels go back to the cells, each shard of columns sums its own
components per cluster, and its slice of a centroid becomes floor(sum / count).

Parts and labels travel as packed arrays, one row per cell, so a round moves about
``k`` * 2 bytes per vector and shard and no row per vector. Only the centroids (``k`` vectors) are
on the driver and sent to tasks. Sums per cluster combine inside each task before the shuffle, so a
cluster that holds most rows costs no more than any other.

Edge cases: vectors that are null, of another length or holding null or non-finite components take
no part; an empty table gives an empty result; with fewer than ``k`` vectors each starts a cluster;
ids may repeat (each row counts); a null id is clustered but starts no cluster; equal start hashes
go by the vector; other columns are ignored. Components beyond 2^26 after scaling could leave the
range of long distances and are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.llm.common import pack, sha256, spool, unpack

LARGEST = 1 << 26
#: Below this, sums of products of up to 2^13 columns are whole numbers that doubles hold exactly.
DOUBLE_SAFE = 1 << 20


def integer_rows(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    whole = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(sound)
    wide = F.exists("embedding", lambda v: F.abs(v.cast("double")) * scale >= LARGEST)
    x = F.when(wide, F.raise_error(F.lit(f"a component times {scale} exceeds {LARGEST}"))).otherwise(whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("x"))


def _cells(dims: int, cell_rows: int, block_columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, cell_rows):
                part = batch.slice(at, cell_rows)
                x = part.column(1).flatten().to_numpy().reshape(-1, dims)
                ids = part.column(0)
                known = np.array([i.is_valid for i in ids], dtype=np.uint8)
                numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cell = f"{place}.{number}"
                number += 1
                for block, a in enumerate(range(0, dims, block_columns)):
                    piece = np.ascontiguousarray(x[:, a : a + block_columns])
                    head = [numbers, known] if block == 0 else [numbers[:0], known[:0]]
                    yield pa.RecordBatch.from_pylist([{"cell": cell, "block": block, "n": len(x), "ids": pack(*head), "data": pack(piece.ravel())}], schema=CELL)

    return run


CELL = pa.schema([("cell", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def _piece(data: bytes, n: int) -> np.ndarray:
    return unpack(data)[0].view(np.int64).reshape(n, -1)


def partial_distances(x: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Exact squared distances over the columns at hand, rows by centroids."""
    if max(np.abs(x).max(initial=0), np.abs(slices).max(initial=0)) < DOUBLE_SAFE:
        a, b = x.astype(float), slices.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in slices], axis=1)


def _parts(centroids: np.ndarray, block_columns: int):
    """Column-block tasks: one packed matrix of partial distances per cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = r.block * block_columns
                part = partial_distances(_piece(r.data, r.n), centroids[:, a : a + block_columns])
                out.append((r.cell, r.n, r.ids, pack(part.ravel())))
            yield pd.DataFrame(out, columns=["cell", "n", "ids", "part"])

    return run


def _labels(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds the parts of one cell row and takes the nearest centroid, the smaller number on ties."""
    n = int(pdf["n"].iloc[0])
    total = sum(_piece(p, n) for p in pdf["part"])
    label = total.argmin(axis=1)
    ids = max(pdf["ids"], key=len)
    return pd.DataFrame([{"cell": key[0], "ids": ids, "label": pack(label.astype(np.int64)), "distance": pack(total[np.arange(n), label])}])


LABELS = "cell string, ids binary, label binary, distance binary"


def _sums(k: int):
    """Sums of a shard's columns per cluster, over all cells of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, label = _piece(r.data, r.n), unpack(r.label)[0].view(np.int64)
                sums, counts = held.setdefault(r.block, (np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)))
                np.add.at(sums, label, x)
                counts += np.bincount(label, minlength=k)
        rows = [(b, c, int(counts[c]), sums[c].tolist()) for b, (sums, counts) in held.items() for c in range(k) if counts[c]]
        yield pd.DataFrame(rows, columns=["block", "cluster", "n", "sums"])

    return run


def _slice(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's new slices: exact floor of the mean of every cluster that has rows."""
    rows = []
    for cluster, part in pdf.groupby("cluster"):
        total, n = [sum(map(int, column)) for column in zip(*part["sums"], strict=True)], int(part["n"].sum())
        rows.append((int(key[0]), int(cluster), [t // n for t in total]))
    return pd.DataFrame(rows, columns=["block", "cluster", "slice"])


def start_rows(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(digest.alias("h"), "x").orderBy("h", "x").limit(k)
    return np.array([r["x"] for r in first.collect()], dtype=np.int64)  # k vectors


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, cell_rows: int = 2048, block_columns: int = 32) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) per vector, and the final centroids."""
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, dims, scale)
    centroids = start_rows(rows, k, seed)
    result = T.StructType.fromDDL("vec_id long, cluster int, distance long")
    if not len(centroids):
        return spark.createDataFrame([], result), centroids
    cells = spool(rows.mapInArrow(_cells(dims, cell_rows, block_columns), "cell string, block int, n int, ids binary, data binary"), "cells")

    def assigned(centroids: np.ndarray) -> DataFrame:
        parts = cells.mapInPandas(_parts(centroids, block_columns), "cell string, n int, ids binary, part binary")
        return parts.groupBy("cell").applyInPandas(_labels, LABELS)

    for _ in range(rounds):
        held = cells.select("cell", "block", "n", "data").join(assigned(centroids).select("cell", "label"), "cell")
        sums = held.select("block", "n", "data", "label").mapInPandas(_sums(len(centroids)), "block int, cluster int, n long, sums array<long>")
        slices = sums.groupBy("block").applyInPandas(_slice, "block int, cluster int, slice array<long>")
        centroids = centroids.copy()
        for r in slices.collect():  # k slices per shard of columns
            a = r["block"] * block_columns
            centroids[r["cluster"], a : a + len(r["slice"])] = r["slice"]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, label, distance in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                numbers, known = unpack(ids.as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers.view(np.int64), mask=known == 0),
                        pa.array(unpack(label.as_py())[0].astype(np.int32)),
                        pa.array(unpack(distance.as_py())[0].view(np.int64)),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    return spool(assigned(centroids).mapInArrow(unpacked, result), "clusters"), centroids


def cluster_report(embeddings: DataFrame) -> DataFrame:
    """Every vector's cluster with the inertia of its cluster and of all, and its centroid's digest."""
    rows, centroids = clusters(embeddings)
    spark = embeddings.sparkSession
    digests = [(c, sha256(",".join(map(str, v.tolist())))) for c, v in enumerate(centroids)]
    sizes = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = sum(r["cluster_inertia"] for r in sizes.collect())  # k rows
    facts = sizes.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").withColumn("inertia", F.lit(inertia).cast("long"))
    out = rows.join(F.broadcast(facts), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
