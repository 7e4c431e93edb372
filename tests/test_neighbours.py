"""Exact neighbours and local density against all pairs; the detection plan on real lines."""

import numpy as np
import pandas as pd
import pytest

from marketweave.operators import neighbours as nb
from marketweave.operators import outliers as ol
from marketweave.plans import q_outliers as qo

DATA = "/root/testdata/sf0.001"


def distances(x):
    d = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - x[None, :, c]) ** 2
    d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    return d


def brute_lof(x, k):
    d = distances(x)
    k = min(k, len(x) - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    lrd = 1 / (np.maximum(dist[:, -1][near], dist).mean(axis=1) + 1e-10)
    return lrd[near].mean(axis=1) / lrd


def shapes(name):
    rng = np.random.default_rng(6)
    if name == "clusters":
        return np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(8, 0.05, (300, 3)), rng.uniform(-30, 30, (60, 3))])
    if name == "one wide column":
        return np.column_stack([rng.integers(1, 51, 700), rng.uniform(900, 100_000, 700), rng.integers(0, 11, 700) / 100])
    return rng.normal(size=(250, 20))


@pytest.mark.parametrize("shape", ["clusters", "one wide column", "many columns"])
@pytest.mark.parametrize("cells", [1000, 3])  # one and two levels of cuts
def test_neighbours_are_exact(spark, monkeypatch, shape, cells):
    monkeypatch.setattr(nb, "ASKING_ROWS", 37)
    monkeypatch.setattr(nb, "BLOCK_CELLS", 900)
    x = shapes(shape)
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": x.tolist(), "w": 1}), "id long, v array<double>, w long")
    got = nb.nearest_points(points, 7, region_rows=25, cells=cells, sample_rows=400).toPandas().sort_values(["q", "dist", "p"])
    d = distances(x)
    assert len(got) == 7 * len(x) and (got["n"] == 1).all()
    np.testing.assert_allclose(got["dist"].to_numpy().reshape(-1, 7), np.sort(d, axis=1)[:, :7], rtol=1e-12)


@pytest.mark.parametrize("shape", ["clusters", "one wide column"])
def test_leaves_of_a_region_lose_no_neighbour(monkeypatch, shape):
    monkeypatch.setattr(nb, "LEAF_ROWS", 6)
    looked = []
    distances_of = nb._distances
    monkeypatch.setattr(nb, "_distances", lambda a, b: looked.append(len(a) * len(b)) or distances_of(a, b))
    x = np.round(shapes(shape), 1)
    x = np.unique(x, axis=0)
    ids, d = np.random.default_rng(1).permutation(len(x)), distances(x)
    others = pd.DataFrame({"id": ids, "v": list(x), "w": 1}).sort_values("id")
    got = {ids_: (p, dist) for ids_, p, dist, _ in nb._nearest(others["id"].to_numpy(), nb._matrix(others["v"]), None, others, 5)}
    for i, me in enumerate(ids):
        want = sorted(zip(d[i], ids))[:5]
        assert got[me][0] == [w[1] for w in want] and np.allclose(got[me][1], [w[0] for w in want])
    assert sum(looked) < 0.7 * len(x) ** 2
    radius = np.sort(d, axis=1)[:, 2][np.argsort(ids)]
    for i, p, dist, _ in nb._nearest(others["id"].to_numpy(), nb._matrix(others["v"]), radius, others, 5):
        assert len(p) >= 3 and i not in p and dist[2] == pytest.approx(radius[i]) and max(dist) <= radius[i] * (1 + 1e-9)


def test_forest_walk_equals_the_nodes():
    from marketweave.operators import anomalies as an

    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 3))
    forest, walked = [], []
    for t in range(4):
        nodes = []
        an._grow(x[:200], np.random.default_rng(t), 0, 8, nodes)
        forest.append(nodes)
        walked.append(an._walkable(pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])))
    x[5] = [np.inf, -np.inf, np.nan]

    def depth(nodes, row):
        f, cut, left, right, depth = nodes[0]
        while f >= 0:
            f, cut, left, right, depth = nodes[left if row[f] < cut else right]
        return depth

    np.testing.assert_allclose(an._depths(x, walked), [sum(depth(n, row) for n in forest) for row in x], rtol=1e-12)


def test_forest_scores_each_line_once(spark):
    plan = qo.outlier_auto_detection(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_regions_stay_small(spark):
    x = shapes("clusters").repeat(6, axis=0) + np.random.default_rng(3).normal(0, 1e-3, (4560, 3))
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": x.tolist(), "w": 1}), "id long, v array<double>, w long")
    placed = nb.into_regions(points, len(x), 50, 8, 2000)
    sizes = placed.groupBy("region").count().toPandas()["count"]
    assert sizes.sum() == len(x) and sizes.max() <= 150 and len(sizes) > 60


def test_density_with_copies_ties_and_gaps(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (150, 2)), np.repeat([[5.0, 5.0]], 90, 0), rng.integers(0, 4, (40, 2)) * 10.0, [[40.0, -40.0]]])
    rows = [(i, float(a), float(b), "x") for i, (a, b) in enumerate(x)]
    rows += [(900, None, 1.0, "x"), (901, float("nan"), 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, a double, b double, w string")
    got = nb.local_outlier_factor(df, ["a", "b"], ["id"], 10, region_rows=20).toPandas().set_index("id").sort_index()
    assert len(got) == len(rows) and got.loc[[900, 901], "lof"].isna().all() and (got.loc[[900, 901], "outlier_lof"] == 0).all()
    # copies count one by one; rows whose k-th distance is tied between places may take either
    d = np.sort(distances(x), axis=1)
    clear = [i for i in range(150) if d[i, 9] < d[i, 10] and (x[i] != 5).all()]
    want = brute_lof(x, 10)
    untied = [i for i in clear if all(d[j, 9] < d[j, 10] for j in np.argsort(distances(x)[i])[:10])]
    assert len(untied) > 100
    np.testing.assert_allclose(got.loc[untied, "lof"].astype(float), want[untied], rtol=1e-9)
    assert got.loc[len(x) - 1, "outlier_lof"] == 1 and np.allclose(got.loc[150:239, "lof"].astype(float), 1.0)
    assert nb.local_outlier_factor(df.limit(0), ["a", "b"], ["id"]).collect() == []


def test_whole_detection_plan_on_lines(spark):
    """All five methods on every line of the smallest table, each against its rule over arrays."""
    cols = [*qo.COLS, "l_discount", "l_tax"]
    lines = pd.read_parquet(f"{DATA}/lineitem.parquet").drop_duplicates(list(qo.PK), keep=False).set_index(list(qo.PK)).sort_index()[cols]
    lines.iloc[::900, 1] *= 40 + np.arange(len(lines.iloc[::900]))  # some far apart
    plan = ol.detection_plan(spark.createDataFrame(lines.reset_index()), cols)
    got = ol.detect(spark.createDataFrame(lines.reset_index()), plan, qo.PK).drop(*cols).toPandas().set_index(list(qo.PK)).sort_index()
    assert got.index.equals(lines.index)
    methods = {m: plan[m] for m in ("iqr", "mad", "zscore")}
    assert cols[1] not in plan["zscore"]  # skewed by the planted ones
    assert set(got.columns) == {f"{c}_outlier_{m}" for m, cs in methods.items() for c in cs} | {"anomaly_score", "outlier_isolation_forest", "outlier_lof"}
    for c in cols:
        x = lines[c]
        q1, q3 = x.quantile([0.25, 0.75])
        mad = (x - x.median()).abs().median()
        assert (got[f"{c}_outlier_iqr"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))).all()
        assert c not in plan["zscore"] or (got[f"{c}_outlier_zscore"] == (((x - x.mean()) / x.std()).abs() > 3)).all()
        assert (got[f"{c}_outlier_mad"] == (0.6745 * (x - x.median()).abs() / mad > 3)).all()
    lof = brute_lof(lines.to_numpy(float), 20)
    sure = np.abs(lof - 1.5) > 0.01  # ties at the k-th distance move a factor a little
    assert ((got["outlier_lof"].to_numpy() == (lof > 1.5)) | ~sure).all() and (lof > 1.5).any()
    score = got["anomaly_score"].astype(float)
    assert (got["outlier_isolation_forest"] == (score > 0.5)).all() and score.between(0, 1).all()
    assert qo.outlier_auto_detection(spark, DATA).count() == 6000
    far = np.sqrt((((lines - lines.mean()) / lines.std()) ** 2).sum(axis=1))
    assert score[far.nlargest(100).index].mean() > score.mean()


def test_plan_rules(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=60), "b": rng.pareto(0.6, 60), "c": rng.normal(size=60)}))
    assert ol.detection_plan(df, ["a", "b", "c"]) == {"iqr": ["a", "b", "c"], "mad": ["a", "b", "c"], "zscore": ["a", "c"], "isolation_forest": ["a", "b", "c"], "lof": ["a", "b", "c"]}
    assert set(ol.detection_plan(df, ["a", "c"])) == {"iqr", "mad", "zscore", "lof"}


def test_a_region_is_sent_the_value_of_a_point_once(spark, monkeypatch):
    """Rows that go to the densities: as many as regions know points, not as lists have entries."""
    x = shapes("clusters")
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(len(x))))
    sent = []
    of = nb._of_neighbours
    monkeypatch.setattr(nb, "_of_neighbours", lambda lists, wanted, *a: sent.append((wanted.count(), wanted.distinct().count())) or of(lists, wanted, *a))
    got = nb.local_outlier_factor(df, ["a", "b", "c"], ["id"], 10, region_rows=100).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got["lof"], brute_lof(x, 10), rtol=1e-9)
    assert len(sent) == 2 and all(rows == different < 0.5 * 10 * len(x) for rows, different in sent)
