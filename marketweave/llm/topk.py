"""Exact top-k search by inner product: a ball tree per shard.

Vectors become integers, floor(scale * x). They are dealt to cells by the nearest of a few pivots
(fitted on a bounded hash sample of ``pivot_sample`` rows) and, inside a cell, to groups of at most
about 64 MB by a hash of the id. A group is cut in space, at medians, into shards of at most
``shard_rows`` rows, so shards stay small balls where a cell holds many, and a group of equal
vectors splits as well. Each shard is a ball tree: a node knows its centre c and radius r, and no
row in it can exceed q.c + |q| r.

Queries travel in blocks. First every query visits the shard with the largest bound and gets a k-th
score. That score is shared: a query then visits only shards whose bound still reaches it, and
inside a shard only nodes whose bound does, in order of the bounds, while its k-th score rises.
Scores are exact integers; ties go to the smaller id.

Edge cases: vectors that are null, hold null or non-finite components or have another dimension
than most take no part; an empty table gives an empty result; ids may repeat (each row is a
candidate; a query does not meet rows of its own id); null ids take no part; other columns are
ignored. Scores are sums of doubles, exact while no vector's own product reaches 2^53; larger
vectors are an error, not a wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import spool

LEAF = 512
GROUP_BYTES = 64 << 20


def across(part: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Products of the rows with the direction between two rows far from each other; away: the
    distances from the centre."""
    one = part[int(away.argmax())]
    far = ((part - one) ** 2).sum(axis=1)
    return part @ (part[int(far.argmax())] - one)


def space_cuts(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows in parts of at most ``most``, halved at medians."""
    done, open_ = [], [np.arange(len(rows))]
    while open_:
        at = open_.pop()
        if len(at) <= most:
            done.append(at)
            continue
        part = rows[at]
        half = len(at) // 2
        order = np.argpartition(across(part, ((part - part.mean(axis=0)) ** 2).sum(axis=1)), half)
        open_ += [at[order[half:]], at[order[:half]]]
    return done


class BallTree:
    """Rows in leaf order with centre and radius of every node; leaves are scored as one product."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(ids))
        self.leaves: list[tuple[int, int]] = []
        self.nodes: list[tuple[int, int, int]] = []  # left child, right child, leaf number
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.rows = rows
        self._grow(order, 0, len(order))
        self.ids, self.rows = ids[order], rows[order]

    def _grow(self, order: np.ndarray, a: int, b: int) -> int:
        part = self.rows[order[a:b]]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append((-1, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(away.max()))
        if b - a <= LEAF or self.radii[me] == 0:
            self.nodes[me] = (-1, -1, len(self.leaves))
            self.leaves.append((a, b))
            return me
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(across(part, away), half)]
        left = self._grow(order, a, a + half)
        right = self._grow(order, a + half, b)
        self.nodes[me] = (left, right, -1)
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores that can be among its k best; floor: known k-th scores."""
        centres, radii = np.array(self.centres), np.array(self.radii)
        norms = np.sqrt((queries**2).sum(axis=1))
        # bounds of all nodes at once; rounding is covered by a slack far above it
        bounds = queries @ centres.T + norms[:, None] * radii[None, :] + 1e-6 * (1 + norms[:, None])
        alive = {0: np.arange(len(queries))}
        kept_ids = [np.empty(0, dtype=np.int64)] * len(queries)
        kept = [np.empty(0)] * len(queries)
        kth = floor.astype(float).copy()
        # best nodes first: leaves are visited in order of the block's largest bound above the floor
        stack = [0]
        while stack:
            node = stack.pop()
            who = alive.pop(node)
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                continue
            left, right, leaf = self.nodes[node]
            if leaf < 0:
                gain = {c: float((bounds[who, c] - kth[who].clip(-1e300)).max()) for c in (left, right)}
                for child in sorted((left, right), key=lambda c: gain[c]):
                    alive[child] = who
                    stack.append(child)
                continue
            a, b = self.leaves[leaf]
            scores = queries[who] @ self.rows[a:b].T
            for i, s in zip(who, scores, strict=True):
                ok = (s >= kth[i]) & (self.ids[a:b] != query_ids[i])
                if not ok.any():
                    continue
                cand_ids = np.concatenate((kept_ids[i], self.ids[a:b][ok]))
                cand = np.concatenate((kept[i], s[ok]))
                best = np.lexsort((cand_ids, -cand))[:k]
                kept_ids[i], kept[i] = cand_ids[best], cand[best]
                if len(best) == k:
                    kth[i] = max(kth[i], kept[i][-1])
        return list(zip(kept_ids, kept, strict=True))


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and the integer vector as doubles; rows that take no part are gone."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(sound)
    return rows.select("vec_id", x.alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _blocks(pdf: pd.DataFrame) -> dict:
    return {"ids": np.ascontiguousarray(pdf["vec_id"].to_numpy(np.int64)).tobytes(), "rows": np.ascontiguousarray(_matrix(pdf["x"])).tobytes()}


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = 8192, block_rows: int = 1024, pivot_sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score for the queries with vec_id divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings, scale)
    own = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("top")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if sizes["top"] >= 2**53:
        raise ValueError(f"the product of a vector with itself is {sizes['top']:.3g} at scale {scale}: scores from 2^53 on are not exact")
    d, n = int(sizes["d"]), int(sizes["n"])
    rows = rows.where(F.size("x") == d)
    pivots = _pivots(rows, n, shard_rows, pivot_sample)
    fixed = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        m = _matrix(x)
        return pd.Series(((fixed.value**2).sum(axis=1)[None, :] - 2 * m @ fixed.value.T).argmin(axis=1).astype("int32"))

    placed = spool(rows.select("vec_id", "x", nearest("x").alias("cell")), "vectors")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    group_rows = min(16 * shard_rows, max(shard_rows, GROUP_BYTES // (8 * d)))
    groups = placed.join(F.broadcast(cells), "cell").select("vec_id", "x", "cell", F.pmod(F.xxhash64("vec_id", F.hash("x")), F.ceil(F.col("m") / group_rows)).cast("int").alias("salt"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, out = _matrix(pdf["x"]), pdf["vec_id"].to_numpy(np.int64), []
        for i, at in enumerate(space_cuts(x, shard_rows)):
            part = x[at]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max())
            out.append({"shard": f"{key[0]}.{key[1]}.{i}", "centre": centre, "radius": radius, "ids": ids[at].tobytes(), "rows": part.tobytes()})
        return pd.DataFrame(out)

    packed = spool(groups.groupBy("cell", "salt").applyInPandas(pack, "shard string, centre array<double>, radius double, ids binary, rows binary"), "shards")
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "x", F.hash("x").alias("check"))
    n_blocks = max(1, -(-queries.count() // block_rows))
    n_balls = max(1, -(-packed.count() // 4096))

    def ball_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"ball": int(key[0]), "shards": list(pdf["shard"]), "centres": _matrix(pdf["centre"]).tobytes(), "radii": pdf["radius"].to_numpy(float).tobytes()}])

    balls = packed.select("shard", "centre", "radius", F.pmod(F.xxhash64("shard"), F.lit(n_balls)).alias("ball")).groupBy("ball")
    balls = spool(balls.applyInPandas(ball_block, "ball long, shards array<string>, centres binary, radii binary"), "balls")

    def query_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = {"checks": pdf["check"].to_numpy(np.int64), "floors": pdf["floor"].to_numpy(float)}
        return pd.DataFrame([{"homes": list(pdf["home"]), **_blocks(pdf), **{k: v.tobytes() for k, v in columns.items()}}])

    def routes(rows: DataFrame, best_only: bool) -> DataFrame:
        """Shards for the queries (with home shard and floor): of each block of balls the one with
        the largest bound, or all but the home whose bound reaches the floor."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    q = np.frombuffer(r.rows).reshape(-1, d)
                    ids, checks, floors = np.frombuffer(r.ids, np.int64), np.frombuffer(r.checks, np.int64), np.frombuffer(r.floors)
                    c, radius = np.frombuffer(r.centres).reshape(-1, d), np.frombuffer(r.radii)
                    norms = np.sqrt((q**2).sum(axis=1))
                    bound = q @ c.T + norms[:, None] * radius[None, :] + 1e-6 * (1 + norms[:, None])
                    names = np.array(list(r.shards), dtype=object)
                    if best_only:
                        i, j = np.arange(len(q)), bound.argmax(axis=1)
                    else:
                        homes = np.array(list(r.homes), dtype=object)
                        i, j = np.nonzero((bound >= floors[:, None]) & (homes[:, None] != names[None, :]))
                    if len(i):
                        yield pd.DataFrame({"query_id": ids[i], "check": checks[i].astype(np.int32), "x": list(q[i]), "shard": names[j], "bound": bound[i, j], "floor": floors[i]})

        blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "check"), F.lit(n_blocks))).groupBy("block")
        blocks = blocks.applyInPandas(query_block, "homes array<string>, ids binary, rows binary, checks binary, floors binary")
        spread = blocks.withColumn("ball", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_balls - 1).cast("long"))))
        return spread.join(balls, "ball").drop("ball").mapInPandas(run, "query_id long, check int, x array<double>, shard string, bound double, floor double")

    start = queries.withColumns({"home": F.lit(""), "floor": F.lit(float("-inf"))})
    best = F.max(F.struct("bound", "shard")).alias("best")
    home = routes(start, True).groupBy("query_id", "check").agg(best, F.first("x").alias("x"))
    home = spool(home.select("query_id", "check", "x", F.col("best.shard").alias("shard"), F.lit(float("-inf")).alias("floor")), "homes")

    def visit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "check": [], "vec_id": [], "score": []}, dtype=np.int64)]
        if len(left) and len(right):
            q, floor, asked = _matrix(left["x"]), left["floor"].to_numpy(float), left["query_id"].to_numpy(np.int64)
            for r in right.itertuples(index=False):
                tree = BallTree(np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.rows).reshape(-1, d))
                for a in range(0, len(left), block_rows):
                    part = slice(a, a + block_rows)
                    for i, (ids, scores) in enumerate(tree.search(asked[part], q[part], k, floor[part]), a):
                        out.append(pd.DataFrame({"query_id": asked[i], "check": int(left["check"].iloc[i]), "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out)

    result = "query_id long, check int, vec_id long, score long"
    def searched(rows: DataFrame) -> DataFrame:
        """The queries at their shards, at most about ``shard_rows`` of them in a task: a shard that
        more ask for is searched by several."""
        parts = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
        left = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("query_id", "check"), F.col("parts")))
        right = packed.join(parts, "shard").select("shard", "ids", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        left = left.select("query_id", "check", "x", "floor", "shard", "part")
        return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(visit, result)

    first = spool(searched(home.select("query_id", "check", "x", "shard", "floor")), "first")
    kth = first.groupBy("query_id", "check").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("low"))
    known = home.drop("floor").join(kth, ["query_id", "check"], "left")
    floor = F.when(F.col("m") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf")))
    known = known.select(F.col("query_id").alias("vec_id"), "x", "check", F.col("shard").alias("home"), floor.alias("floor"))
    second = searched(spool(routes(known, False).select("query_id", "check", "x", "shard", "floor"), "routes"))
    best = Window.partitionBy("query_id", "check").orderBy(F.desc("score"), "vec_id")  # at most k rows a query and task reach the shuffle
    return first.union(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pivots(rows: DataFrame, n: int, shard_rows: int, pivot_sample: int) -> np.ndarray:
    """Centres of cells: a few rounds of k-means on a bounded hash sample (at most 1024 cells)."""
    wanted = int(min(1024, max(1, n // shard_rows)))
    share = min(1.0, pivot_sample / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("x").limit(2 * pivot_sample).toPandas()
    if len(sample) < wanted or wanted == 1:
        return np.zeros((1, len(rows.select("x").first()["x"])))
    x = _matrix(sample["x"])
    rng = np.random.default_rng(1)
    centres = x[rng.choice(len(x), wanted, replace=False)]
    for _ in range(5):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for c in range(wanted):
            mine = x[near == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres
