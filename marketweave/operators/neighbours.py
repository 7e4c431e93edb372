"""Exact nearest neighbours in regions of bounded size.

Equal rows are one point with a weight, so copies cost one row. A tree cuts space into cells along
the widest column of a bounded sample, and, where the table is larger than ``cells`` regions, a
second tree per cell, grown in tasks on a bounded sample of the cell, cuts it further: regions hold
about ``region_rows`` points whatever the table's size (up to cells * CELL_REGIONS regions, beyond
which they grow). Each point first finds its k nearest in its own region. The distance of the last of
them bounds the search: it then asks only the other regions whose box reaches into that ball, most
points none at all. Both sides of a region are read in slices of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.session import cut

CELL_REGIONS = 256
LEAF_ROWS = 128
ASKING_ROWS = 20_000
BLOCK_CELLS = 4_000_000


class Splits:
    """A tree of cuts x[column] < value; places are numbered by leaves."""

    def __init__(self, x: np.ndarray, leaves: int):
        column, value, low, high, leaf = [], [], [], [], []
        todo = [(np.arange(len(x)), leaves, -1, False)]
        count = 0
        while todo:
            rows, wanted, parent, right = todo.pop()
            me = len(column)
            if parent >= 0:
                (high if right else low)[parent] = me
            part = x[rows]
            width = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(x.shape[1])
            for target, v in ((column, -1), (value, 0.0), (low, -1), (high, -1), (leaf, -1)):
                target.append(v)
            if wanted <= 1 or not len(rows) or not width.max() > 0:
                leaf[me] = count
                count += 1
                continue
            c = int(width.argmax())
            line = np.sort(part[:, c])
            at = line[len(line) * (wanted // 2) // wanted]
            at = at if at > line[0] else line[np.searchsorted(line, line[0], side="right")]
            column[me], value[me] = c, float(at)
            left = part[:, c] < at
            todo += [(rows[left], wanted // 2, me, False), (rows[~left], wanted - wanted // 2, me, True)]
        self.column, self.value, self.low, self.high, self.leaf = (np.array(a) for a in (column, value, low, high, leaf))
        self.count = count

    def place(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        inner = self.column[at] >= 0
        while inner.any():
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = np.where(x[i, self.column[node]] < self.value[node], self.low[node], self.high[node])
            inner = self.column[at] >= 0
        return self.leaf[at]


def _matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column by column, so that no array of rows by rows by columns is built."""
    out = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        out += (a[:, c, None] - b[None, :, c]) ** 2
    return np.sqrt(out)


def weighted_points(df: DataFrame, cols: Sequence[str], pk: Sequence[str]) -> DataFrame:
    """One row per different vector: its smallest key's number as id, the vector, the count."""
    numbers = [F.col(c).cast("double").alias(c) for c in cols]
    clean = df.select(*pk, *numbers).dropna(subset=list(cols))
    for c in cols:
        clean = clean.where(~F.isnan(c))
    # -0.0 and 0.0 are one place
    clean = clean.withColumns({c: F.col(c) + 0.0 for c in cols})
    # a hash of the vector keeps ids apart where keys repeat or are not one number
    key = F.min(F.col(pk[0]).cast("long")) if len(pk) == 1 else F.xxhash64(*cols, F.min(F.xxhash64(*pk)))
    return clean.groupBy(*cols).agg(F.count(F.lit(1)).alias("w"), key.alias("id"))


def into_regions(points: DataFrame, rows: int, region_rows: int, cells: int, sample_rows: int) -> DataFrame:
    """points (id, v, w) with the number of their region."""
    spark = points.sparkSession
    first = min(cells, math.ceil(rows / region_rows))
    part = lambda share: F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003
    sample = points.where(part(F.lit(min(1.0, sample_rows / rows)))).select("v").limit(2 * sample_rows)
    tree = Splits(_matrix(r["v"] for r in sample.collect()).reshape(-1, len(points.select("v").first()["v"])), first)  # sample_rows vectors

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.place(_matrix(v)))

    placed = points.withColumn("cell", cell_of("v"))
    if rows <= cells * region_rows:
        return cut(placed.select("id", "v", "w", (F.col("cell") * CELL_REGIONS).alias("region")))
    placed = cut(placed)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # one row per cell
    picked = placed.join(F.broadcast(sizes), "cell").where(part(F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n"))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = min(CELL_REGIONS, math.ceil(int(pdf["n"].iloc[0]) / region_rows))
        t = Splits(_matrix(pdf["v"]), leaves)
        return pd.DataFrame([(int(key[0]), *(a.tolist() for a in (t.column, t.value, t.low, t.high, t.leaf)))], columns=["cell", "column", "value", "low", "high", "leaf"])

    grown = picked.select("cell", "v", "n").groupBy("cell").applyInPandas(grow, "cell long, column array<int>, value array<double>, low array<int>, high array<int>, leaf array<int>")
    trees = {}
    for r in grown.collect():  # at most 2 * CELL_REGIONS nodes per cell
        t = trees[r["cell"]] = Splits.__new__(Splits)
        t.column, t.value, t.low, t.high, t.leaf = (np.array(r[c]) for c in ("column", "value", "low", "high", "leaf"))
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("long")
    def region_of(cell: pd.Series, v: pd.Series) -> pd.Series:
        x, c = _matrix(v), cell.to_numpy()
        out = c * CELL_REGIONS
        for one in np.unique(c):
            if one in shared.value:
                mine = np.flatnonzero(c == one)
                out[mine] += shared.value[one].place(x[mine])
        return pd.Series(out)

    return cut(placed.select("id", "v", "w", region_of("cell", "v").alias("region")))


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k smallest (distance, id); ids are sorted."""
    if dist.shape[1] <= k:
        return np.argsort(dist, axis=1, kind="stable")
    near = np.sort(np.argpartition(dist, k - 1, axis=1)[:, :k], axis=1)
    order = np.argsort(np.take_along_axis(dist, near, axis=1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    last = np.take_along_axis(dist, near[:, -1:], axis=1)
    for i in np.flatnonzero((dist <= last).sum(axis=1) > k):  # the k-th distance occurs beyond the k
        near[i] = np.argsort(dist[i], kind="stable")[:k]
    return near


FOUND = "p array<long>, dist array<double>, n array<long>"


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of points to boxes, column by column."""
    out = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        out += np.maximum(np.maximum(low[None, :, c] - x[:, c, None], x[:, c, None] - high[None, :, c]), 0) ** 2
    return np.sqrt(out)


def _box_gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of the box around the points to boxes."""
    gap = np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0)
    return np.sqrt((gap**2).sum(axis=1))


def _wider(radius: np.ndarray) -> np.ndarray:
    return radius * (1 + 1e-12) + 1e-300


def _nearest(ids: np.ndarray, x: np.ndarray, radius: np.ndarray | None, others: pd.DataFrame, k: int) -> Iterator[tuple]:
    """Per asking row: the ids, distances and counts of its nearest points, its own copies first, none
    beyond its radius. Without radii the others are the asking rows, in the same order."""
    others = others.sort_values("id")
    at, y, many = others["id"].to_numpy(), _matrix(others["v"]), others["w"].to_numpy()
    tree = Splits(y, max(1, len(y) // max(LEAF_ROWS, 4 * k)))
    leaf = tree.place(y)
    order = np.argsort(leaf, kind="stable")
    starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    low, high = np.minimum.reduceat(y[order], starts), np.maximum.reduceat(y[order], starts)
    leaves = np.split(order, starts[1:])
    where = tree.place(x)
    asking = np.argsort(where, kind="stable")
    for rows in np.split(asking, np.flatnonzero(np.diff(where[asking])) + 1):
        home = np.flatnonzero(leaf[order][starts] == where[rows[0]])
        step = max(1, BLOCK_CELLS // len(at))
        for part in (rows[a : a + step] for a in range(0, len(rows), step)):
            bound = np.full(len(part), np.inf)
            if radius is not None:
                bound = radius[part]
            elif len(home) and len(leaves[home[0]]) > k:
                inner = _distances(x[part], y[leaves[home[0]]])
                inner[ids[part][:, None] == at[leaves[home[0]]][None, :]] = np.inf
                bound = np.partition(inner, k - 1, axis=1)[:, k - 1]
            reach = _wider(bound)
            near = np.flatnonzero(_box_gaps(x[part], low, high) <= reach.max())
            near = near[(_gaps(x[part], low[near], high[near]) <= reach[:, None]).any(axis=0)]
            if not len(near):
                continue
            mine = np.sort(np.concatenate([leaves[i] for i in near]))
            dist = _distances(x[part], y[mine])
            count = np.broadcast_to(many[mine], dist.shape) - (ids[part][:, None] == at[mine][None, :])
            dist[(count == 0) | (dist > reach[:, None])] = np.inf
            best = _best(dist, at[mine], k)
            d, c = np.take_along_axis(dist, best, axis=1), np.take_along_axis(count, best, axis=1)
            p, known = at[mine][best], np.isfinite(d).sum(axis=1)
            for i, n in enumerate(known.tolist()):
                yield int(part[i]), p[i, :n].tolist(), d[i, :n].tolist(), c[i, :n].tolist()


def _reached(x: np.ndarray, radius: np.ndarray, own: int, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """Per point of a region the other regions whose box reaches into its ball."""
    found: list[list[int]] = [[] for _ in range(len(x))]
    reach = _wider(radius)
    order = np.argsort(reach, kind="stable")  # so that few wide balls meet many boxes
    for rows in (order[a : a + 256] for a in range(0, len(order), 256)):
        near = np.flatnonzero((_box_gaps(x[rows], low, high) <= reach[rows].max()) & (names != own))
        for a in range(0, len(near), 4096):
            some = near[a : a + 4096]
            i, box = np.nonzero(_gaps(x[rows], low[some], high[some]) <= reach[rows][:, None])
            for row, region in zip(rows[i].tolist(), names[some[box]].tolist()):
                found[row].append(region)
    return found


def _flat(lists: pd.DataFrame, *names: str) -> list[np.ndarray]:
    """The place of the list of each entry, and the entries of these columns."""
    sizes = lists[names[0]].map(len).to_numpy(dtype=np.int64)
    return [np.repeat(np.arange(len(lists)), sizes), *[np.concatenate(lists[c].to_list()) for c in names]]


def nearest_points(points: DataFrame, k: int, region_rows: int = 4096, cells: int = 1024, sample_rows: int = 50_000) -> DataFrame:
    """(q, p, dist, n): the nearest other rows of a row at q, n of them at p, k in all. Rows at
    equal distance go by the id of their point."""
    return nearest_lists(points, k, region_rows, cells, sample_rows).select("q", F.inline(F.arrays_zip("p", "dist", "n")))


def nearest_lists(points: DataFrame, k: int, region_rows: int = 4096, cells: int = 1024, sample_rows: int = 50_000) -> DataFrame:
    """``nearest_points`` with one row per q: its region, and p, dist and n as arrays. Lists are written,
    the rows of a region side by side, and go from task to task as arrays."""
    spark = points.sparkSession
    rows = points.count()
    if not rows:
        return spark.createDataFrame([], f"region long, q long, {FOUND}")
    placed = into_regions(points, rows, region_rows, cells, sample_rows)

    dims = range(len(placed.select("v").first()["v"]))
    corners = placed.groupBy("region").agg(F.array(*[F.min(F.col("v")[i]) for i in dims]).alias("low"), F.array(*[F.max(F.col("v")[i]) for i in dims]).alias("high"))
    boxes = corners.collect()  # one row per region
    shared = spark.sparkContext.broadcast((np.array([b["region"] for b in boxes]), _matrix(b["low"] for b in boxes), _matrix(b["high"] for b in boxes)))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x, region = pdf["id"].to_numpy(), _matrix(pdf["v"]), int(pdf["region"].iloc[0])
        radius, out = np.full(len(x), np.inf), [None] * len(x)
        for i, p, d, n in _nearest(ids, x, None, pdf, k):
            taken = []  # k rows in all
            for many in n:
                taken.append(min(many, k - sum(taken)))
                if sum(taken) == k:
                    radius[i] = d[len(taken) - 1]
                    break
            out[i] = (int(ids[i]), x[i].tolist(), region, p[: len(taken)], d[: len(taken)], taken)
        inside = pd.DataFrame(out, columns=["q", "v", "region", "p", "dist", "n"])
        return inside.assign(radius=radius, asked=_reached(x, radius, region, *shared.value))

    inside = cut(placed.groupBy("region").applyInPandas(local, f"q long, v array<double>, region long, radius double, asked array<long>, {FOUND}"))
    asked = inside.select(F.col("q").alias("id"), "v", "radius", F.col("region").alias("home"), F.explode("asked").alias("region"))
    chunks = asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / ASKING_ROWS).cast("int").alias("chunks"))
    left = asked.join(chunks, "region").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks")
    right = placed.join(chunks, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def outside(pdf: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(others):
            ids, x, home = pdf["id"].to_numpy(), _matrix(pdf["v"]), pdf["home"].to_numpy()
            for i, p, d, n in _nearest(ids, x, pdf["radius"].to_numpy(), others, k):
                out.append((int(home[i]), int(ids[i]), p, d, n))
        return pd.DataFrame(out, columns=["region", "q", "p", "dist", "n"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of all lists of a row."""
        row, p, d, n = _flat(pdf, "p", "dist", "n")
        q = pdf["q"].to_numpy()[row]
        order = np.lexsort((p, d, q))
        q, p, d, n = (x[order] for x in (q, p, d, n))
        first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
        before = np.cumsum(n) - n
        before = before - np.repeat(before[first], np.diff(first, append=len(q)))
        kept = before < k
        q, p, d, n = q[kept], p[kept], d[kept], np.minimum(n, k - before)[kept]
        first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
        lists = [[part.tolist() for part in np.split(x, first[1:])] for x in (p, d, n)]
        return pd.DataFrame({"region": int(pdf["region"].iloc[0]), "q": q[first], "p": lists[0], "dist": lists[1], "n": lists[2]})

    by = ("region", "chunk")
    row = f"region long, q long, {FOUND}"
    beyond = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(outside, row)
    names, border, some = ["region", "q", "p", "dist", "n"], F.size("asked") > 0, F.size("p") > 0
    lists = inside.where(border).select(*names).unionByName(beyond).where(some)
    return inside.where(~border).select(*names).where(some).unionByName(cut(lists.groupBy("region").applyInPandas(merged, row)))


def _of_neighbours(lists: DataFrame, wanted: DataFrame, value: DataFrame, measure, column: str, *used: str) -> DataFrame:
    """(q, column): ``measure`` of the starts of the lists of a region, the values of their points and the arrays ``used``. Each region is sent
    the value (q, x) of a point once, however many of its lists hold it (``wanted``: region, p)."""

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"q": [], column: []})
        known = known.sort_values("p")
        row, p, *rest = _flat(pdf, "p", *used)
        x = known["x"].to_numpy()[np.searchsorted(known["p"].to_numpy(), p)]
        return pd.DataFrame({"q": pdf["q"].to_numpy(), column: measure(np.flatnonzero(np.diff(row, prepend=-1)), x, *rest)})

    values = wanted.join(value.select(F.col("q").alias("p"), "x"), "p")
    return lists.select("region", "q", "p", *used).groupBy("region").cogroup(values.groupBy("region")).applyInPandas(run, f"q long, {column} double")


def add_local_outlier_factor(df: DataFrame, cols: Sequence[str], pk: Sequence[str], k: int = 20, threshold: float = 1.5, **index) -> DataFrame:
    """df with ``lof``, the ratio of the neighbours' density to the row's own, and ``outlier_lof``,
    1 above the threshold. Rows with a missing value have no factor and no flag. ``pk`` only settles
    ties, so it need not be unique."""
    from marketweave.operators.skew import join_key_values

    cols, pk = list(cols), list(pk)
    places = cut(weighted_points(df, cols, pk))
    near = nearest_lists(places.select("id", F.array(*cols).alias("v"), "w"), k, **index)
    wanted = cut(near.select("region", F.explode("p").alias("p")).distinct())
    mean = lambda first, x, n: np.add.reduceat(n * x, first) / np.add.reduceat(n, first)
    reach = near.select("q", F.array_max("dist").alias("x"))
    dens = cut(_of_neighbours(near, wanted, reach, lambda first, x, d, n: 1.0 / (mean(first, np.maximum(x, d), n) + 1e-10), "lrd", "dist", "n"))
    around = _of_neighbours(near, wanted, dens.withColumnRenamed("lrd", "x"), mean, "m", "n")
    lof = around.join(dens, "q").select(F.col("q").alias("id"), (F.col("m") / F.col("lrd")).alias("lof"))
    keys = [f"__v{i}" for i in range(len(cols))]
    values = places.join(lof, "id", "left").select(*[F.col(c).alias(v) for c, v in zip(cols, keys)], F.col("w").alias("__w"), "lof")
    rows = df.withColumns({v: F.col(c).cast("double") + 0.0 for c, v in zip(cols, keys)})
    whole = F.lit(True)
    for v in keys:
        whole = whole & F.col(v).isNotNull() & ~F.isnan(v)
    names = [c for c in df.columns if c != "lof"]
    known = join_key_values(rows.where(whole), values, keys, "__w").select(*names, "lof")
    rest = rows.where(~whole).select(*names, F.lit(None).cast("double").alias("lof"))
    out = known.unionByName(rest)
    return out.withColumn("outlier_lof", F.coalesce((F.col("lof") > threshold).cast("int"), F.lit(0)))


def local_outlier_factor(df: DataFrame, cols: Sequence[str], pk: Sequence[str], k: int = 20, threshold: float = 1.5, **index) -> DataFrame:
    """(pk, lof, outlier_lof) of every row."""
    return add_local_outlier_factor(df.select(*pk, *cols), cols, pk, k, threshold, **index).select(*pk, "lof", "outlier_lof")
