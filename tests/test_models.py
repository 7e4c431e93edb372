"""Chronological validation against least squares by hand, and the uplift of a second feature set."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.operators import evaluate as ev
from marketweave.operators import ml
from marketweave.operators.axis import Axis
from marketweave.operators.labels import expanding_folds

AXIS = Axis(keys=("key",), order=("day",), bounded=True)
SETS = {"stock_only": ["a"], "integrated": ["a", "b"]}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    start, rows = datetime.date(2020, 1, 1), []
    for key in range(3):
        for i in range(60):
            a, b = float(rng.normal()), float(rng.normal())
            y = 2 * a - 3 * b + key + float(rng.normal()) * 0.1
            rows.append((key, start + datetime.timedelta(days=i), a, None if i == 7 else b, y if i != 11 else None, int(y > 0)))
    return spark.createDataFrame(rows, "key int, day date, a double, b double, y double, up int")


def test_errors_of_folds_match_least_squares(panel):
    got = {(r["feature_set"], r["fold"]): r for r in ml.cross_validate(panel, AXIS, SETS, "y", {"linear": ml.REGRESSORS["linear"]}, folds=2, kind="regression").collect()}
    rows = expanding_folds(ml.fill_features(panel.dropna(subset=["y"]), ["a", "b"]), AXIS, 2).toPandas()
    assert len(got) == 4
    for (name, fold), r in got.items():
        part = rows[rows["fold"] == fold]
        train, test = part[part["role"] == "train"], part[part["role"] == "test"]
        design = lambda t: np.column_stack([np.ones(len(t)), t[SETS[name]].to_numpy()])
        weights = np.linalg.lstsq(design(train), train["y"].to_numpy(), rcond=None)[0]
        error = test["y"].to_numpy() - design(test) @ weights
        assert r["mse"] == pytest.approx(float((error**2).mean()), rel=1e-6)
        assert r["mae"] == pytest.approx(float(np.abs(error).mean()), rel=1e-6)
        assert r["r2"] == pytest.approx(1 - float((error**2).sum() / ((test["y"] - test["y"].mean()) ** 2).sum()), rel=1e-6)


def test_second_set_lifts_every_model(panel):
    for kind, label, models in (("classification", "up", {"logistic": ml.CLASSIFIERS["logistic"]}), ("regression", "y", {k: ml.REGRESSORS[k] for k in ("linear", "ridge")})):
        res = ml.cross_validate(panel, AXIS, SETS, label, models, folds=2, kind=kind)
        lift = ev.uplift(res, ["model", "fold"], ml.METRICS[kind]).collect()
        assert len(lift) == 2 * len(models)
        best = "accuracy_uplift" if kind == "classification" else "r2_uplift"
        assert all(r[best] > 0.1 for r in lift)
        assert kind == "classification" or all(r["mse_uplift"] < 0 for r in lift)


def test_balanced_weights_even_out_the_classes(panel):
    sums = ml.balanced_weights(panel.withColumn("up", (F.col("a") > 1).cast("int")), "up").groupBy("up").agg(F.sum("class_weight").alias("w")).collect()
    assert sums[0]["w"] == pytest.approx(sums[1]["w"])
