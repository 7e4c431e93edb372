"""Approximate nearest neighbours over learned partitions.

A bounded sample of different vectors (``sample_rows``, by hash) gets its exact neighbour graph.
The graph is cut into parts of equal size, so that few edges cross; a small classifier (multinomial
logistic regression) learns the part from the vector. The classifier then places every row of the
table, and sends a query to its most probable parts, whose rows are ranked by their exact distance.

How many parts a query visits is measured, not set: a quarter of the sample is kept from the
partitioning and the classifier, and the smallest number is taken with which these rows would find
``recall`` of their neighbours in the sample. A query that finds fewer than k rows in its parts
searches all. Rows of a part are dealt to shards of about ``shard_rows`` by a hash, so a part or a
group of equal vectors may hold any share of the table; no row is left out of the index.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without id take no part. Distances exist between vectors of one length; the most frequent length is
indexed, each other length is a part of its own that is searched whole. A table without such rows
gives an empty result. Ids may repeat: each row is a candidate, a query does not meet rows of its
own id, and a query repeated with the same vector is asked once. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import spool

RESULT = "query_id long, rank int, vec_id long, score double"
BLOCK = 512


def _matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=float)


def sound_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def nearest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, distances) of the k nearest rows with another id, smaller ids first on
    ties. Products choose the rows, a slack above their error keeps ties; differences score them."""
    scale = (x * x).sum(axis=1).max(initial=0.0)
    for at in range(0, len(q), BLOCK):
        part = q[at : at + BLOCK]
        rough = squared_distances(part, x)
        rough[own[at : at + BLOCK, None] == ids[None, :]] = np.inf
        for i, row in enumerate(rough):
            usable = np.isfinite(row).sum()
            if not usable:
                continue
            bound = np.partition(row, min(k, usable) - 1)[min(k, usable) - 1]
            near = np.flatnonzero(row <= bound + 1e-9 * (scale + part[i] @ part[i]))
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))[:k]
            yield at + i, ids[near][best], exact[best]


# -- learning -----------------------------------------------------------------------------------


def neighbour_graph(spark, x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest other rows of every sample row, from tasks over blocks of the sample."""
    shared = spark.sparkContext.broadcast(x)  # the bounded sample
    degree = min(degree, len(x) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        ids = np.arange(len(rows))
        for pdf in batches:
            for at in pdf["id"]:
                mine = ids[at : at + BLOCK]
                found = list(nearest(rows[mine], mine, rows, ids, degree))
                yield pd.DataFrame({"i": [int(at + n) for n, _, _ in found], "near": [near.tolist() for _, near, _ in found]})

    blocks = spark.range(0, len(x), BLOCK, numPartitions=max(1, min(-(-len(x) // BLOCK), spark.sparkContext.defaultParallelism)))
    edges = blocks.mapInPandas(run, "i long, near array<long>").collect()  # sample_rows lists of `degree`
    return np.array([r["near"] for r in sorted(edges, key=lambda r: r["i"])])


def halved(x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Equal parts by repeated cuts across the direction of the largest spread."""
    label, rng = np.zeros(len(x), dtype=np.int64), np.random.default_rng(seed)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):
            axis = y.T @ (y @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = rows[np.argsort(y @ axis, kind="stable")]
        low = count // 2
        cut = len(rows) * low // count
        todo += [(order[:cut], first, low), (order[cut:], first + low, count - low)]
    return label


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 30, seed: int = 3) -> np.ndarray:
    """Parts of equal size of the neighbour graph. Rows that have more neighbours in another part
    change places with rows of that part, best pairs first, while fewer edges cross."""
    label, rng = halved(x, parts, seed), np.random.default_rng(seed)
    source, target = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    source, target = np.concatenate((source, target)), np.concatenate((target, source))
    everyone = np.arange(len(x))
    for _ in range(sweeps):
        count = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(count, (source, label[target]), 1)
        mine = count[everyone, label].copy()
        count[everyone, label] = -1
        wish = count.argmax(axis=1)
        gain = count[everyone, wish] - mine
        # half of the rows stay put, so that neighbours do not change places with one another
        movers = np.flatnonzero(rng.random(len(x)) < 0.5)
        movers = movers[np.lexsort((-gain[movers], wish[movers], label[movers]))]
        lists: dict[tuple[int, int], list[int]] = {}
        for i, a, b in zip(movers.tolist(), label[movers].tolist(), wish[movers].tolist(), strict=True):
            lists.setdefault((a, b), []).append(i)
        moved = 0
        for (a, b), there in lists.items():
            for i, j in zip(there, lists.get((b, a), ()) if a < b else ()):
                if gain[i] + gain[j] <= 0:
                    break
                label[i], label[j] = b, a
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Linear scores of the parts; the measured number of parts to visit."""

    def __init__(self, weights: np.ndarray, offsets: np.ndarray, probes: int, expected: float):
        self.weights, self.offsets, self.probes, self.expected = weights, offsets, probes, expected

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        return np.argsort(-(x @ self.weights.T + self.offsets), axis=1, kind="stable")


def learn(rows: DataFrame, dims: int, count: int, sample_rows: int, part_rows: int, degree: int, k: int, recall: float) -> Router:
    """Partition, classifier and number of visits from a bounded sample of the rows of one length."""
    spark = rows.sparkSession
    share = min(1.0, 2 * sample_rows / count)
    picked = rows.where(F.size("x") == dims).where(F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    picked = picked.select("x").distinct().orderBy(F.xxhash64("x", F.lit(5)), "x").limit(sample_rows)
    x = np.array([r["x"] for r in picked.collect()], dtype=float).reshape(-1, dims)  # sample_rows vectors
    parts = int(min(-(-count // part_rows), len(x) // 48))
    if parts < 2:
        return Router(np.zeros((1, dims)), np.zeros(1), 1, 1.0)
    held = len(x) // 4
    fitted = x[held:]
    label = balanced_partition(fitted, neighbour_graph(spark, fitted, degree), parts)
    table = spark.createDataFrame(pd.DataFrame({"x": fitted.tolist(), "label": label.astype(float)}), "x array<double>, label double")
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, standardization=False).fit(table.select(array_to_vector("x").alias("features"), "label"))
    router = Router(model.coefficientMatrix.toArray(), np.array(model.interceptVector.toArray()), 1, 0.0)
    # where the neighbours of rows that were not learned from would lie, and how early they are visited
    order = router.order(x)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), axis=0), axis=1)
    near = [ids for _, ids, _ in nearest(x[:held], np.arange(held), x, np.arange(len(x)), k)]
    visited = np.concatenate([place[i, order[ids, 0]] for i, ids in enumerate(near)])
    reached = np.bincount(visited, minlength=parts).cumsum() / len(visited)
    router.probes = int(np.argmax(reached >= recall)) + 1
    router.expected = float(reached[router.probes - 1])
    return router


# -- index and search ---------------------------------------------------------------------------


def approximate_neighbours(
    embeddings: DataFrame, k: int = 10, every: int = 100, recall: float = 0.96, sample_rows: int = 8192, part_rows: int = 1024, degree: int = 10, shard_rows: int = 8192, block_rows: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score for the queries with vec_id divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = spool(sound_rows(embeddings), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dims = int(sizes["d"])
    router = learn(rows, dims, int(sizes["n"]), sample_rows, part_rows, degree, k, recall)
    shared = spark.sparkContext.broadcast(router)  # parts x dims numbers
    parts = len(router.offsets)

    def routed(visits: int):
        @F.pandas_udf("array<int>")
        def route(x: pd.Series) -> pd.Series:
            other = (x.map(len) != dims).to_numpy()
            out = [[-len(v)] for v in x]  # a part of its own per other length
            if not other.all():
                for i, p in zip(np.flatnonzero(~other), shared.value.order(_matrix(x[~other]))[:, :visits].tolist(), strict=True):
                    out[i] = p
            return pd.Series(out)

        return route

    placed = rows.select("vec_id", "x", routed(1)("x")[0].alias("part"))
    placed = spool(placed, "placed")
    shards = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))  # one row per part
    shards = spool(shards, "parts")
    dealt = placed.join(F.broadcast(shards), "part").withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.col("shards")).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.ascontiguousarray(_matrix(pdf["x"]))
        return pd.DataFrame([{"part": int(key[0]), "shard": int(key[1]), "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "data": data.tobytes()}])

    packed = spool(dealt.groupBy("part", "shard").applyInPandas(pack, "part int, shard int, ids binary, data binary"), "shards")
    queries = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x").distinct().withColumn("check", F.xxhash64("x"))

    def visit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "check": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(left) and len(right):
            q, own, check = _matrix(left["x"]), left["query_id"].to_numpy(np.int64), left["check"].to_numpy(np.int64)
            for r in right.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                for i, near, score in nearest(q, own, np.frombuffer(r.data).reshape(len(ids), -1), ids, k):
                    out.append(pd.DataFrame({"query_id": own[i], "check": check[i], "vec_id": near, "score": score}))
        return pd.concat(out)

    def searched(asked: DataFrame) -> DataFrame:
        """The queries at the shards of their parts, at most about ``block_rows`` of them in a task."""
        per_part = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        sized = spool(shards.join(per_part, "part"), "visits")
        left = asked.join(F.broadcast(sized), "part").withColumn("block", F.pmod(F.xxhash64("check", "query_id"), F.col("blocks")).cast("int"))
        left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("query_id", "check", "x", "part", "shard", "block")
        right = packed.join(F.broadcast(sized.select("part", "blocks")), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        by = ("part", "shard", "block")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(visit, "query_id long, check long, vec_id long, score double")
        best = Window.partitionBy("query_id", "check").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # k rows per query leave each task

    probes = min(parts, router.probes)
    found = spool(searched(queries.withColumn("part", F.explode(routed(probes)("x")))), "found")
    if probes < parts:
        full = found.groupBy("query_id", "check").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = spool(queries.where(F.size("x") == dims).join(full, ["query_id", "check"], "left_anti"), "short")
        if not short.isEmpty():
            more = searched(short.withColumn("part", F.explode(routed(parts)("x"))))
            found = found.join(short.select("query_id", "check"), ["query_id", "check"], "left_anti").unionByName(more.select(*found.columns))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
