"""Trees grown from binned rows against Spark ML's own, and the folds they train on."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from marketweave.operators import evaluate as ev
from marketweave.operators import forests, ml
from marketweave.operators.axis import Axis
from marketweave.operators.labels import expanding_folds, fold_blocks

AXIS = Axis(keys=("key",), order=("day",), bounded=True)
COLS = ["a", "b", "c"]
SETS = {"few": ["a", "b"], "all": COLS}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    start, rows = datetime.date(2020, 1, 1), []
    for key in range(4):
        for i in range(150):
            a, b, c = (float(rng.integers(k)) for k in (30, 12, 5))  # few values, so that both bin alike
            y = a * 0.3 - b + c * (a > 15) + float(rng.normal()) * 2
            rows.append((key, start + datetime.timedelta(days=i), a, b, c, y, int(y > 0)))
    return spark.createDataFrame(rows, "key int, day date, a double, b double, c double, y double, up int").cache()


def expected(panel, label, build, kind, names, weights=False):
    folds = expanding_folds(ml.fill_features(panel, COLS).withColumn(label, F.col(label).cast("double")), AXIS, 2)
    out = {}
    for fold in range(2):
        train, test = (folds.filter((F.col("fold") == fold) & (F.col("role") == r)) for r in ("train", "test"))
        train = ml.balanced_weights(train, label) if weights else train
        for name, cols in SETS.items():
            vec = VectorAssembler(inputCols=cols, outputCol="features")
            est = build().setLabelCol(label)
            est = est.setWeightCol("class_weight") if weights else est
            m = (ev.weighted_metrics if kind == "classification" else ev.regression_metrics)(est.fit(vec.transform(train)).transform(vec.transform(test)), label, "prediction").first()
            out[name, fold] = [m[n] for n in names]
    return out


@pytest.mark.parametrize(
    "kind, build, weights",
    [
        ("classification", lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1), False),
        ("regression", lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=1), False),
        ("classification", lambda: RandomForestClassifier(numTrees=2, maxDepth=4, seed=1, bootstrap=False, featureSubsetStrategy="all"), False),
        ("classification", lambda: RandomForestClassifier(numTrees=1, maxDepth=2, seed=1, bootstrap=False), True),
        ("regression", lambda: RandomForestRegressor(numTrees=1, maxDepth=5, seed=1, bootstrap=False), False),
    ],
)
def test_trees_without_chance_are_those_of_spark(panel, monkeypatch, kind, build, weights):
    def never(*a):
        raise AssertionError("a tree was grown by Spark ML")

    label, names = ("up" if kind == "classification" else "y"), ml.METRICS[kind]
    want = expected(panel, label, build, kind, names, weights)
    monkeypatch.setattr(type(build()), "_fit", never)
    got = {(r["feature_set"], r["fold"]): [r[n] for n in names] for r in ml.cross_validate(panel, AXIS, SETS, label, {"m": build}, folds=2, kind=kind, balanced=weights).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9), key


def test_bootstrapped_forests_are_as_good_as_those_of_spark(panel):
    for kind, label, build in (("classification", "up", ml.CLASSIFIERS["random_forest"]), ("regression", "y", ml.REGRESSORS["random_forest"])):
        first = ml.METRICS[kind][0]
        want = expected(panel, label, build, kind, [first])
        runs = [
            {(r["feature_set"], r["fold"]): r[first] for r in ml.cross_validate(rows, AXIS, SETS, label, {"m": build}, folds=2, kind=kind).collect()}
            for rows in (panel, panel.repartition(3, "a"))
        ]
        for key in want:
            assert runs[0][key] == pytest.approx(want[key][0], rel=0.15), (kind, key)
            assert runs[0][key] == pytest.approx(runs[1][key], rel=1e-9)  # however the rows are dealt


def test_blocks_tell_the_folds(panel):
    for rows in (panel, panel.filter("day < '2020-01-03'")):  # the second has no test rows
        blocks = fold_blocks(rows, AXIS, 3)
        role = F.when(F.col("block") <= F.col("fold"), "train").when(F.col("block") == F.col("fold") + 1, "test")
        got = blocks.crossJoin(panel.sparkSession.range(3).select(F.col("id").cast("int").alias("fold"))).withColumn("role", role).dropna(subset=["role"]).select("key", "day", "fold", "role")
        want = expanding_folds(rows, AXIS, 3).select("key", "day", "fold", "role")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_columns_are_counted_two_at_a_time_or_alone(monkeypatch):
    rng = np.random.default_rng(0)
    x, node = rng.integers(0, 8, (3, 500)).astype(np.uint8), rng.integers(0, 4, 500).astype(np.uint8)
    label, weight, target = rng.integers(0, 2, 500), rng.integers(0, 3, 500).astype(float), rng.normal(size=500)
    for classes in (0, 2):
        got = [
            forests._counts(node, 4, forests._pairs(x, classes, label, 8, paired), 3, 8, classes, weight, weight * target, np.empty(500, dtype=np.intp))
            for paired in (True, False)
        ]
        want = np.zeros(got[0].shape)
        for i in range(500):
            for c in range(3):
                want[node[i], c, x[c, i]] += np.eye(2)[label[i]] * weight[i] if classes else (weight[i], weight[i] * target[i])
        assert np.allclose(got[0], want) and np.allclose(got[1], want)


def test_cuts_of_many_values_are_quantiles_of_all_rows(spark):
    rows = spark.range(40_000).select(F.col("id").cast("double").alias("v"), F.lit(0.0).alias("flat"), F.lit(0).alias("block"))
    v, flat = forests.cuts(rows, ["v", "flat"], "block", [0], 32)[0]
    assert len(v) == 31 and len(flat) == 0
    assert np.abs(v - np.arange(1, 32) * 1250).max() <= 40_000 / forests.POINTS + 1
