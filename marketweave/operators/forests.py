"""Random forests and boosted trees with the settings of Spark ML's estimators, grown from binned rows.

What is grown is what Spark ML grows: at most ``maxBins`` bins per column, at each node the split of
the largest gain (Gini or variance) among the columns the node may use, trees in levels, the leaves
of a class that agree merged. Three things differ. Cuts are quantiles of all training rows, not of a sample of
10 000. A row's Poisson count in a tree's bootstrap comes from the hash of its key, so it does not
depend on how rows are dealt. And rows are kept by column in blocks of bytes, so that a level of all
trees of all fits is one pass: rows find their node by comparing whole columns, and the columns of a
node are counted two at a time. Memory per task is one block and the counts of the level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK_ROWS = 131_072
#: Most cells of a count of two columns for one row of a block; above, columns are counted one by one.
CELLS_PER_ROW = 0.3
#: Ranks that tell the values of a block of rows; the cuts are off by one of them at most.
POINTS = 1024
#: Most bytes of a level's counts that the driver adds up itself; more are added up in tasks.
DRIVER_BYTES = 32_000_000
#: Depth that a byte per row can name.
MOST_LEVELS = 8


@dataclass
class Settings:
    """What a Spark ML estimator of trees is asked to do."""

    boosted: bool
    classes: bool
    trees: int
    depth: int
    bins: int
    seed: int
    step: float = 1.0
    rate: float = 1.0
    bootstrap: bool = True
    subset: str = "auto"

    @staticmethod
    def of(est) -> Settings | None:
        """None for other estimators, and for settings that are not grown here."""
        p = lambda name: est.getOrDefault(name)
        if not isinstance(est, (RandomForestClassifier, RandomForestRegressor, GBTClassifier, GBTRegressor)):
            return None
        boosted, classes = isinstance(est, (GBTClassifier, GBTRegressor)), isinstance(est, (RandomForestClassifier, GBTClassifier))
        plain = p("minInstancesPerNode") == 1 and p("minInfoGain") == 0 and p("minWeightFractionPerNode") == 0 and p("maxDepth") <= MOST_LEVELS and p("maxBins") <= 256
        if boosted:
            usual = p("subsamplingRate") == 1 and p("featureSubsetStrategy") == "all" and not (est.hasParam("validationIndicatorCol") and est.isDefined("validationIndicatorCol"))
            usual = usual and p("lossType") == ("logistic" if classes else "squared")
            out = Settings(True, classes, p("maxIter"), p("maxDepth"), p("maxBins"), p("seed"), p("stepSize"))
        else:
            usual = p("impurity") == ("gini" if classes else "variance") and p("featureSubsetStrategy") in ("auto", "all", "sqrt", "onethird")
            usual = usual and not (classes and est.isDefined("thresholds"))
            out = Settings(False, classes, p("numTrees"), p("maxDepth"), p("maxBins"), p("seed"), 1.0, p("subsamplingRate"), p("bootstrap"), p("featureSubsetStrategy"))
        return out if plain and usual else None

    def columns_per_node(self, n: int) -> int:
        kind = self.subset
        if self.boosted or kind == "all" or (kind == "auto" and self.trees == 1):
            return n
        if kind == "sqrt" or (kind == "auto" and self.classes):
            return math.ceil(math.sqrt(n))
        return math.ceil(n / 3)


@dataclass
class Fit:
    """One ensemble in the making: the fold it trains on, its columns (places among all), its trees by heap order of their nodes."""

    fold: int
    cols: list[int]
    classes: int  # 0: means
    class_weight: list[float] | None = None
    feature: list[np.ndarray] = field(default_factory=list)  # place of the column among all, -1 at a leaf
    cut: list[np.ndarray] = field(default_factory=list)  # bins up to this go left
    value: list[np.ndarray] = field(default_factory=list)  # of each place of the last level


# -- cuts and blocks --------------------------------------------------------------------------


def _thinned(parts: list[tuple[np.ndarray, np.ndarray]], points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and weights as at most so many values of equal weight; few stay as they are."""
    v, w = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    if len(v) <= points:
        return v, w
    ranks = np.cumsum(w)
    at = np.searchsorted(ranks, (np.arange(points) + 0.5) / points * ranks[-1])
    return v[at], np.full(points, ranks[-1] / points)


def cuts(rows: DataFrame, cols: Sequence[str], block: str, folds: Sequence[int], bins: int) -> dict[int, list[np.ndarray]]:
    """Per fold and column the upper ends of the bins, but the last: midpoints of the values where there are few,
    else quantiles of the training rows (those of a block up to the fold). All rows are sorted, in blocks,
    and each task hands on POINTS ranks of them per block and column."""
    last = max(folds)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        seen: dict[tuple[int, int], list] = {}

        def sort(b: int) -> None:
            for c, x in enumerate(np.concatenate(held.pop(b), axis=1)):
                seen.setdefault((b, c), []).append(_thinned([(np.sort(x), np.ones(len(x)))], POINTS))

        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            table = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)])
            for b in np.unique(at).tolist():
                held.setdefault(b, []).append(table[:, at == b])
                if sum(t.shape[1] for t in held[b]) >= BLOCK_ROWS:
                    sort(b)
        for b in list(held):
            sort(b)
        for (b, c), parts in seen.items():
            v, w = _thinned(parts, POINTS)
            columns = [pa.array([b], pa.int32()), pa.array([c], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "c", "v", "w"])

    source = rows.where(F.col(block) <= last).select(F.col(block).cast("int"), *[F.col(c).cast("double") for c in cols])
    found = source.mapInArrow(summed, "b int, c int, v binary, w binary").collect()  # POINTS numbers per task, block and column
    out: dict[int, list[np.ndarray]] = {}
    for f in folds:
        out[f] = []
        for i, c in enumerate(cols):
            parts = [(np.frombuffer(r["v"]), np.frombuffer(r["w"])) for r in found if r["c"] == i and r["b"] <= f]
            if not parts:
                out[f].append(np.zeros(0))
                continue
            v, w = _thinned(parts, sum(len(p[0]) for p in parts))
            ranks = np.cumsum(w)
            at = np.unique(v[np.searchsorted(ranks, np.arange(1, bins) / bins * ranks[-1] - 1e-9)])
            if len(at) < bins - 1:
                few = np.sort([r[0] for r in rows.where(F.col(block) <= f).select(F.col(c).cast("double")).distinct().limit(bins + 1).collect()])
                at = (few[1:] + few[:-1]) / 2 if len(few) <= bins else at
            out[f].append(at)
    return out


def tasks(spark, rows: int) -> int:
    """Some blocks per task; fewer tasks than cores only for tables of a few thousand rows."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // 4096)), -(-rows // (4 * BLOCK_ROWS)))


def binned(columns: Sequence[np.ndarray], ends: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x, side="left").astype(np.uint8) for e, x in zip(ends, columns)])


def blocks(rows: DataFrame, cols: Sequence[str], label: str, block: str, keys: Sequence[str], ends: dict[int, list[np.ndarray]], parts: int) -> RDD:
    """(block, hashes, labels, {fold: bins by column}) of the training rows, dealt evenly over ``parts`` tasks."""
    last = max(ends)
    names = [f"x{f}" for f in ends]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(b: int) -> pa.RecordBatch:
            rows = np.concatenate(held.pop(b), axis=1)
            xs = [binned(rows[2:], ends[f]).tobytes() if b <= f else b"" for f in ends]
            row = [[b], [rows[0].tobytes()], [rows[1].tobytes()], *[[x] for x in xs]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *[pa.array(v, pa.binary()) for v in row[1:]]], names=["b", "h", "y", *names])

        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            # hashes ride along as the bits of a double
            table = np.stack([batch.column(1).to_numpy(zero_copy_only=False).view(np.float64), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)]])
            for b in np.unique(at).tolist():
                held.setdefault(b, []).append(table[:, at == b])
                if sum(t.shape[1] for t in held[b]) >= BLOCK_ROWS:
                    yield out(b)
        for b in list(held):
            yield out(b)

    source = rows.where(F.col(block) <= last).select(F.col(block).cast("int"), F.xxhash64(*keys), F.col(label).cast("double"), *[F.col(c).cast("double") for c in cols])
    schema = "b int, h binary, y binary, " + ", ".join(f"{n} binary" for n in names)
    folds = list(ends)

    def numbered(part: Iterator) -> Iterator:
        first = TaskContext.get().partitionId()
        for i, r in enumerate(part):
            h, y = np.frombuffer(r["h"], dtype=np.uint64), np.frombuffer(r["y"], dtype=float)
            yield first + i, (r["b"], h, y, {f: np.frombuffer(r[f"x{f}"], dtype=np.uint8).reshape(len(cols), len(y)) for f in folds if r["b"] <= f})

    return source.mapInArrow(packed, schema).rdd.mapPartitions(numbered).partitionBy(parts, lambda k: k).values()


# -- one level --------------------------------------------------------------------------------


def placed(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Number of the node of each row ``levels`` below the root; below a leaf rows stay left."""
    node, masks = np.zeros(x.shape[1], dtype=np.uint8), [True]
    for level in range(levels):
        first, below = 2**level - 1, []
        go = np.zeros(x.shape[1], dtype=bool)
        for j, mask in enumerate(masks):
            f = feature[first + j]
            if mask is False or f < 0:
                below += [mask, False]
                continue
            right = x[f] > cut[first + j]
            if mask is not True:
                right &= mask
            go |= right
            below += [~right if mask is True else mask ^ right, right] if level + 1 < levels else []
        node <<= 1
        node |= go.view(np.uint8)
        masks = below
    return node


def _pairs(x: np.ndarray, classes: int, label: np.ndarray, bins: int, paired: bool) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Columns, alone or two together, with the number of each row's cell."""
    out = []
    step = 2 if paired else 1
    for a in range(0, len(x), step):
        places = tuple(range(a, min(a + step, len(x))))
        cell = x[a].astype(np.intp)
        for b in places[1:]:
            cell = cell * bins + x[b]
        out.append((places, cell * classes + label if classes else cell))
    return out


def _counts(node: np.ndarray, nodes: int, pairs: list, width: int, bins: int, classes: int, weight: np.ndarray | None, target: np.ndarray | None, buffer: np.ndarray) -> np.ndarray:
    """(nodes, columns, bins, statistics): weights per class, or weight and weighted target."""
    stats = classes or 2
    out = np.empty((nodes, width, bins, stats))
    at = node.astype(np.intp)
    for places, cell in pairs:
        size = bins ** len(places) * (classes or 1)
        if nodes > 1:
            np.multiply(at, size, out=buffer)
            buffer += cell
            cell = buffer
        got = [np.bincount(cell, weight, minlength=nodes * size)] if classes else [np.bincount(cell, w, minlength=nodes * size) for w in (weight, target)]
        for i, g in enumerate(got):
            g = g.reshape(nodes, *[bins] * len(places), -1)
            if len(places) == 2:
                parts = g.sum(axis=2), g.sum(axis=1)
            else:
                parts = (g,)
            for place, part in zip(places, parts):
                if classes:
                    out[:, place] = part
                else:
                    out[:, place, :, i] = part[..., 0]
    return out


def _subsets(seed: int, tree: int, level: int, cols: int, k: int) -> np.ndarray:
    """Columns each node of a level may use."""
    if k == cols:
        return np.tile(np.arange(cols), (2**level, 1))
    return np.sort(np.argsort(np.random.default_rng([seed, tree, level]).random((2**level, cols)), axis=1)[:, :k], axis=1)


def _draws(rate: float) -> np.ndarray:
    """Poisson counts by 16 bits of a hash."""
    edges, p, total = [], math.exp(-rate), 0.0
    for k in range(1, 64):
        total += p
        edges.append(total)
        p *= rate / k
    return np.searchsorted(edges, (np.arange(65536) + 0.5) / 65536, side="right").astype(float)


def _salt(seed: int, tree: int) -> np.uint64:
    return np.uint64(2 * int(np.random.default_rng([seed, tree]).integers(2**62)) + 1)


def best_splits(hist: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """Per node: whether a split gains, the column's place, the last bin on the left, statistics of node, left and right."""
    total = hist[:, 0].sum(axis=1)
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None] - left

    def score(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = s.sum(axis=-1) if classes else s[..., 0]
        top = (s * s).sum(axis=-1) if classes else s[..., 1] ** 2
        return n, np.divide(top, n, out=np.zeros_like(n), where=n > 0)

    (nl, sl), (nr, sr), (n, sp) = score(left), score(right), score(total)
    gain = sl + sr - sp[:, None, None]
    none = 1e-12 * n[:, None, None]  # what rounding leaves of weights that are not whole numbers
    gain[(nl <= none) | (nr <= none) | (gain <= 1e-13 * (sl + sr))] = -np.inf
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(hist), dtype=int)
    rows = np.arange(len(hist))
    splits = hist.shape[2] - 1
    f, b = best // splits, best % splits
    return flat[rows, best] > -np.inf, f, b, total, left[rows, f, b], right[rows, f, b]


def _grow(chunks: RDD, fits: list[Fit], s: Settings, trees: Sequence[int], bins: int, prepared) -> None:
    """Grow trees of these numbers in every fit, level by level, each level one pass over the blocks.

    ``prepared(chunk, fit number)`` gives label (of classes) and target (of means) of the block's rows."""
    size = 2**s.depth - 1
    grown = {(i, t): (np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.uint8)) for i in range(len(fits)) for t in trees}
    stats = {k: [None] * (2 * size + 1) for k in grown}
    alive = {k: {0} for k in grown}
    table, salts = _draws(s.rate), {t: _salt(s.seed, t) for t in trees}
    boot = s.bootstrap and not s.boosted
    for level in range(s.depth):
        nodes = 2**level
        todo = [k for k in grown if any(a >= nodes - 1 for a in alive[k])]
        if not todo:
            break
        now = {k: grown[k] for k in todo}

        def counted(part: Iterator, now=now, level=level, nodes=nodes) -> Iterator:
            acc: dict = {}
            for chunk in part:
                b, h, y, xs = chunk[:4]
                buffer = np.empty(len(y), dtype=np.intp)
                for i, fit in enumerate(fits):
                    mine = [t for t in trees if (i, t) in now]
                    if b > fit.fold or not mine:
                        continue
                    x = xs[fit.fold]
                    label, target = prepared(chunk, i)
                    used = x[fit.cols]
                    pairs = _pairs(used, fit.classes, label, bins, nodes * bins * bins * max(1, fit.classes) <= CELLS_PER_ROW * len(y))
                    given = None if fit.class_weight is None else np.array(fit.class_weight).take(y.astype(np.intp))
                    k = s.columns_per_node(len(fit.cols))
                    for t in mine:
                        weight = given
                        if boot:
                            weight = table.take(((h * salts[t]) >> np.uint64(48)).view(np.int64))
                            weight = weight if given is None else weight * given
                        aim = target if weight is None or target is None else weight * target
                        got = _counts(placed(x, *now[i, t], level), nodes, pairs, len(used), bins, fit.classes, weight, aim, buffer)
                        if k < len(fit.cols):
                            got = np.take_along_axis(got, _subsets(s.seed, t, level, len(fit.cols), k)[:, :, None, None], axis=1)
                        acc[i, t] = acc[i, t] + got if (i, t) in acc else got
            yield from acc.items()

        kinds = [fit.classes for fit in fits]
        size_of = lambda i: 8 * nodes * s.columns_per_node(len(fits[i].cols)) * bins * (kinds[i] or 2)
        if chunks.getNumPartitions() * sum(size_of(i) for i, _ in todo) <= DRIVER_BYTES:  # few enough to add up here
            sums: dict = {}
            for key, hist in chunks.mapPartitions(counted).collect():
                sums[key] = sums[key] + hist if key in sums else hist
            found = [(key, best_splits(hist, kinds[key[0]])) for key, hist in sums.items()]
        else:
            found = chunks.mapPartitions(counted).reduceByKey(add, min(len(todo), chunks.getNumPartitions())).map(lambda kv: (kv[0], best_splits(kv[1], kinds[kv[0][0]]))).collect()
        for key, (splits, f, at, total, left, right) in found:  # a few numbers per node
            i, t = key
            width = len(fits[i].cols)
            sub = _subsets(s.seed, t, level, width, s.columns_per_node(width))
            for j in range(nodes):
                me = nodes - 1 + j
                if me not in alive[key]:
                    continue
                stats[key][me] = total[j] if stats[key][me] is None else stats[key][me]
                if splits[j]:
                    grown[key][0][me], grown[key][1][me] = fits[i].cols[sub[j, f[j]]], at[j]
                    stats[key][2 * me + 1], stats[key][2 * me + 2] = left[j], right[j]
                    alive[key] |= {2 * me + 1, 2 * me + 2}
    for (i, t), (feature, cut) in grown.items():
        _finish(fits[i], feature, cut, stats[i, t], size)


def _finish(fit: Fit, feature: np.ndarray, cut: np.ndarray, stats: list, size: int) -> None:
    """Merge leaves that agree, as Spark ML does, and note the value of each place of the last level."""
    if stats[0] is None:
        raise ValueError(f"fold {fit.fold} has no training rows")
    worth = lambda s: s / s.sum() if fit.classes else s[1] / s[0]
    says = lambda s: int(np.argmax(s)) if fit.classes else s[1] / s[0]
    leaf = lambda n: n >= size or feature[n] < 0
    for n in reversed(range(size)):
        if feature[n] >= 0 and leaf(2 * n + 1) and leaf(2 * n + 2) and says(stats[2 * n + 1]) == says(stats[2 * n + 2]):
            feature[n] = -1
    at = [worth(stats[0])] + [None] * (2 * size)
    for n in range(size):
        split = feature[n] >= 0
        at[2 * n + 1] = worth(stats[2 * n + 1]) if split else at[n]
        at[2 * n + 2] = worth(stats[2 * n + 2]) if split else at[n]
    fit.feature.append(feature)
    fit.cut.append(cut)
    fit.value.append(np.array(at[size:], dtype=float))


# -- ensembles --------------------------------------------------------------------------------


def _levels(fit: Fit) -> int:
    return int(math.log2(len(fit.feature[0]) + 1))


def grow_forests(chunks: RDD, fits: list[Fit], s: Settings, bins: int) -> None:
    def prepared(chunk, i):
        return (chunk[2].astype(np.intp), None) if fits[i].classes else (None, chunk[2])

    _grow(chunks, fits, s, range(s.trees), bins, prepared)


def grow_boosted(chunks: RDD, fits: list[Fit], s: Settings, bins: int) -> None:
    """Each tree is grown on what the trees before it leave; the blocks carry the sums of those trees."""
    state, before = chunks, None
    for number in range(s.trees):
        first = number == 0

        def prepared(chunk, i, first=first):
            y = 2.0 * chunk[2] - 1.0 if s.classes else chunk[2]
            if first:
                return None, y
            sums = chunk[4][i]
            return None, (4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * sums, 700.0))) if s.classes else 2.0 * (y - sums))

        _grow(state, fits, s, [number], bins, prepared)
        if before is not None:
            before.unpersist()
        if number + 1 == s.trees:
            break
        last = [(fit.fold, fit.feature[-1], fit.cut[-1], fit.value[-1] * (1.0 if first else s.step)) for fit in fits]

        def moved(chunk, last=last, first=first):
            b, h, y, xs = chunk[:4]
            sums = {}
            for i, (fold, feature, cut, value) in enumerate(last):
                if b <= fold:
                    more = value.take(placed(xs[fold], feature, cut, s.depth))
                    sums[i] = more if first else chunk[4][i] + more
            return b, h, y, xs, sums

        before = None if state is chunks else state
        state = state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
    if state is not chunks:
        state.unpersist()


def predicted(fit: Fit, s: Settings, x: np.ndarray) -> np.ndarray:
    levels = _levels(fit)
    total = 0.0
    for t, (feature, cut, value) in enumerate(zip(fit.feature, fit.cut, fit.value)):
        total = total + value.take(placed(x, feature, cut, levels), axis=0) * (s.step if s.boosted and t else 1.0)
    if s.boosted:
        return (total > 0).astype(float) if s.classes else total
    return total.argmax(axis=1).astype(float) if s.classes else total / len(fit.feature)


def scored(rows: DataFrame, cols: Sequence[str], label: str, fit: Fit, s: Settings, ends: list[np.ndarray]) -> DataFrame:
    """(label, prediction) of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(len(cols) + 1)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(predicted(fit, s, binned(columns[1:], ends)))], names=[label, "prediction"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS // 2:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return rows.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, f"`{label}` double, prediction double")
