"""Multivariate anomaly detectors: isolation forest, elliptic envelope, density noise (local density: neighbours.py)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions.num import flag
from marketweave.operators.quantiles import exact_quantiles


# -- isolation forest -------------------------------------------------------------------------


def _path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append(None)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    if depth >= limit or len(x) <= 1 or not len(spread):
        nodes[at] = (-1, 0.0, -1, -1, depth + _path_norm(len(x)))
        return at
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = _grow(x[x[:, f] < cut], rng, depth + 1, limit, nodes)
    right = _grow(x[x[:, f] >= cut], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut, left, right, 0.0)
    return at


#: Rows that walk down a tree together; their arrays stay in the cache.
WALKING_ROWS = 2048


def _walkable(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Feature and cut of each node, right and left child, depth of each leaf, levels. A leaf leads to itself."""
    feature, own = nodes["feature"].to_numpy(), np.arange(len(nodes))
    inner = feature >= 0
    child = np.column_stack([np.where(inner, nodes["right"], own), np.where(inner, nodes["left"], own)]).astype(np.intp)
    levels, at = 0, np.zeros(1, dtype=np.intp)
    while inner[at].any():
        levels, at = levels + 1, child[at[inner[at]]].ravel()
    return np.where(inner, feature, 0).astype(np.intp), np.where(inner, nodes["cut"], -np.inf), child.ravel(), nodes["depth"].to_numpy(float), levels


def _depths(x: np.ndarray, forest: list) -> np.ndarray:
    """Sum over the trees of the depth each row comes to."""
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    total = np.zeros(len(x))
    for feature, cut, child, depth, levels in forest:
        at = np.zeros(len(x), dtype=np.intp)
        for _ in range(levels):
            at = child.take(2 * at + (flat.take(first + feature.take(at)) < cut.take(at)))
        total += depth.take(at)
    return total


def isolation_forest(
    df: DataFrame, cols: Sequence[str], pk: Sequence[str], trees: int = 100, rows_per_tree: int = 256, contamination: float | None = None, seed: int = 42
) -> DataFrame:
    """Score every row with trees grown on small hash samples.

    Each tree sees ``rows_per_tree`` rows chosen by hash; all samples together are at most
    trees * rows_per_tree rows, whatever the size of the table. Trees are grown in tasks, one
    group per tree, and broadcast for scoring. A hash gives each row a run of neighbouring trees
    that may take it, one tree in a large table, all of them in a small one. Without
    ``contamination`` a score above 0.5 is an anomaly. With fewer than 10 rows there are no scores.
    """
    cols, pk = list(cols), list(pk)
    clean = df.dropna(subset=cols)
    rows = clean.count()
    if rows < 10:
        return df.withColumns({"anomaly_score": F.lit(None).cast("double"), "outlier_isolation_forest": F.lit(0)})
    unit = lambda t: F.pmod(F.xxhash64(*pk, t, F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0
    base = clean.select(*pk, *[F.col(c).cast("double").alias(c) for c in cols])
    # twice the wanted share of rows keeps the chance of a short sample negligible
    share = min(1.0, 2.0 * rows_per_tree / rows)
    run = math.ceil(trees * share)
    first = F.pmod(F.xxhash64(F.lit(seed), *pk), F.lit(trees))
    offered = F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda k: ((first + k) % trees).cast("int"))
    picked = base.withColumn("tree", F.explode(F.filter(offered, lambda t: unit(t) < trees * share / run))).withColumn("__u", unit(F.col("tree")))
    limit = math.ceil(math.log2(rows_per_tree))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["__u", *pk])[cols].to_numpy(float)[:rows_per_tree]
        nodes: list = []
        _grow(x, np.random.default_rng(seed + tree), 0, limit, nodes)
        return pd.DataFrame(
            [(tree, i, *n, len(x)) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "depth", "n"]
        )

    grown = picked.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, depth double, n int"
    )
    table = grown.toPandas()  # at most trees * (2 * rows_per_tree - 1) nodes
    forest = [_walkable(g.sort_values("node")) for _, g in table.groupby("tree")]
    norm = _path_norm(float(table["n"].max()))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            total = np.concatenate([_depths(x[i : i + WALKING_ROWS], shared.value) for i in range(0, len(x), WALKING_ROWS)]) if len(x) else np.zeros(0)
            yield pd.Series(np.power(2.0, -total / len(shared.value) / norm))

    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    scored = df.withColumn("anomaly_score", F.when(complete, score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])))
    cut = 0.5 if contamination is None else exact_quantiles(scored, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    return scored.withColumn("outlier_isolation_forest", flag(F.col("anomaly_score") > cut))


# -- elliptic envelope ------------------------------------------------------------------------


def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], np.ndarray]:
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return [row[f"m{i}"] for i in range(len(cols))], cov


def squared_distance(cols: Sequence[str], mean: Sequence[float], cov: np.ndarray):
    inv = np.linalg.pinv(cov)
    out = F.lit(0.0)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            out = out + (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) * float(inv[i, j])
    return out


def elliptic_envelope(df: DataFrame, cols: Sequence[str], contamination: float = 0.1, steps: int = 3) -> DataFrame:
    """Mahalanobis distance, the farthest share flagged. Each step refits mean and covariance on
    the nearest half of the rows, which keeps far rows from hiding themselves; 0 steps is the
    classical estimate."""
    cols = list(cols)
    clean = df.dropna(subset=cols)
    mean, cov = _moments(clean, cols)
    for _ in range(steps):
        d = clean.withColumn("__d", squared_distance(cols, mean, cov))
        half = exact_quantiles(d, ["__d"], [0.5])["__d"][0]
        mean, cov = _moments(d.filter(F.col("__d") <= half), cols)
    out = df.withColumn("mahalanobis", squared_distance(cols, mean, cov))
    cut = exact_quantiles(out, ["mahalanobis"], [1 - contamination])["mahalanobis"][0]
    return out.withColumn("outlier_elliptic_envelope", flag(F.col("mahalanobis") > cut))


# -- density noise ----------------------------------------------------------------------------


def _cells(cols: Sequence[str], side: float) -> list:
    return [F.floor(F.col(c) / side).cast("long").alias(f"c{i}") for i, c in enumerate(cols)]


def dbscan_noise(df: DataFrame, cols: Sequence[str], pk: Sequence[str], eps: float = 0.5, min_points: int = 5, salts: int | None = None) -> DataFrame:
    """Rows that belong to no dense region (exact, for any number of columns).

    Space is cut into cells whose diagonal is at most eps. All rows of a cell with
    min_points rows are core rows, without comparing any of them. Only rows of thin cells (fewer
    than min_points each) look at their neighbour cells, so each row meets a bounded number of
    them; a crowded neighbour cell is spread over salts. Noise is a row of a thin cell that is
    not core and has no core row within eps. Beyond three columns neighbours are looked for in a
    grid over the first three, of cells eps wide, and told by their distance in all columns.
    """
    from marketweave.session import cut

    cols, pk = list(cols), list(pk)
    d, g = len(cols), min(len(cols), 3)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    grid_side, reach = (side, math.ceil(math.sqrt(d) + 1e-6)) if d <= 3 else (eps * (1 + 1e-9), 1)
    cell = [f"c{i}" for i in range(d)]
    grid = [f"g{i}" for i in range(g)]
    # equal rows are one point with a weight, so heavy ties cost one row
    points = cut(
        df.dropna(subset=cols).groupBy(*[F.col(c).cast("double").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("w")).withColumn("pid", F.xxhash64(*cols))
        .select("*", *_cells(cols, side), *[F.floor(F.col(c) / grid_side).cast("long").alias(x) for c, x in zip(cols, grid)])
    )
    sizes = points.groupBy(*cell).agg(F.sum("w").alias("size"), F.count(F.lit(1)).alias("n"))
    fullest = points.groupBy(*grid).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    salts = salts or math.ceil(fullest / 1_000_000)
    thin_cells = sizes.filter(F.col("size") < min_points).select(*cell)
    thin = cut(points.join(thin_cells, cell))
    # thin rows announce themselves to the neighbour cells, once per salt
    offsets = list(itertools.product(range(-reach, reach + 1), repeat=g))
    offset = F.explode(F.array(*[F.array(*[F.lit(o) for o in off]) for off in offsets]))
    asking = (
        thin.select(F.col("pid").alias("q"), *[F.col(c).alias(f"q_{c}") for c in cols], F.col("w").alias("qw"), *grid)
        .withColumn("o", offset)
        .select("q", "qw", *[f"q_{c}" for c in cols], *[(F.col(x) + F.col("o")[i]).alias(x) for i, x in enumerate(grid)])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = points.withColumn("salt", F.pmod(F.col("pid"), F.lit(salts)).cast("int"))
    gap = F.lit(0.0)
    for c in cols:
        gap = gap + (F.col(c) - F.col(f"q_{c}")) * (F.col(c) - F.col(f"q_{c}"))
    near = asking.join(salted, [*grid, "salt"]).filter(gap <= eps * eps)
    core_thin = cut(near.groupBy("q").agg(F.sum("w").alias("near")).filter(F.col("near") >= min_points).select("q"))
    # core rows: all of the crowded cells, plus the thin ones found above
    core = points.join(thin_cells, cell, "left_anti").unionByName(points.join(core_thin.withColumnRenamed("q", "pid"), "pid", "left_semi").select(points.columns))
    salted_core = core.withColumn("salt", F.pmod(F.col("pid"), F.lit(salts)).cast("int"))
    covered = asking.join(salted_core, [*grid, "salt"]).filter(gap <= eps * eps).select("q").distinct()
    noise = thin.join(covered.withColumnRenamed("q", "pid"), "pid", "left_anti").select(*cols, F.lit(1).alias("outlier_dbscan"))
    keyed = df.select(*pk, *[F.col(c).cast("double").alias(c) for c in cols])
    return keyed.join(noise, cols, "left").fillna(0, ["outlier_dbscan"])
