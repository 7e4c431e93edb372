"""How often rows are read and frames are gone through."""

from __future__ import annotations

import datetime
import math

import pytest

from marketweave.operators import series as s
from marketweave.operators.axis import Axis

AXIS = Axis(keys=("key",), order=("day",), bounded=True)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_full_frames_are_told_by_running_counts(spark):
    start = datetime.date(2020, 1, 1)
    values = [3.0, None, 1.0, float("nan"), 2.0, 5.0, -4.0, 0.5, float("inf"), 7.0, 7.0, 1.5]
    df = spark.createDataFrame([(k, start + datetime.timedelta(days=i), v) for k in (1, 2) for i, v in enumerate(values)], "key int, day date, x double")
    out = s.rolling_features(df, AXIS, ["x"], (2, 3))
    assert plan_of(out).count("count(x") == 1
    rows = {r["day"]: r for r in out.where("key = 2").collect()}
    for i in range(len(values)):
        row, frame = rows[start + datetime.timedelta(days=i)], values[i - 2 : i + 1] if i >= 2 else []
        if len(frame) < 3 or None in frame:
            assert all(row[f"x_rolling_{st}_3"] is None for st in ("mean", "std", "min", "max", "median"))
            continue
        ordered = sorted(frame, key=lambda v: (math.isnan(v), v))
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip((row["x_rolling_min_3"], row["x_rolling_median_3"], row["x_rolling_max_3"]), ordered))
        if all(map(math.isfinite, frame)):
            mean = sum(frame) / 3
            assert row["x_rolling_mean_3"] == pytest.approx(mean)
            assert row["x_rolling_std_3"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in frame) / 2))


def test_class_report_reads_its_rows_once(spark):
    from marketweave.operators import evaluate as ev

    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (1.0, None), (None, 1.0)], "y double, p double")
    out = ev.class_report(df, "y", "p")
    assert plan_of(out).count("LogicalRDD") == 1
    got = {r["class"]: (r["support"], r["tp"], r["precision"], r["recall"]) for r in out.where("support > 0").collect()}
    assert got == {0.0: (2, 1, 1.0, 0.5), 1.0: (2, 1, 0.25, 0.5), 2.0: (1, 0, 0.0, 0.0)}


def test_training_rows_hold_only_what_fits_read(spark):
    from marketweave.plans import q_models as qm

    rows = qm.training_rows(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["key", "day", *qm.STOCK, *qm.NEWS, "target_return", "target_up"]


def test_clusters_do_not_read_the_source_again(spark):
    from marketweave.plans import q_models as qm

    out = qm.regime_clusters(spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    assert out.count() == 3


def test_cluster_scores_match_their_definition(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from marketweave.operators import ml

    x = np.random.default_rng(2).normal(size=(60, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 20, axis=0)
    scored, scores = ml.cluster(spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["i", "features"]), 3)
    c = np.array([r["cluster"] for r in scored.orderBy("i").collect()])
    means = np.array([x[c == k].mean(axis=0) for k in range(3)])
    within = ((x - means[c]) ** 2).sum()
    between = ((means[c] - x.mean(axis=0)) ** 2).sum()
    assert scores.first()["calinski_harabasz"] == pytest.approx((between / 2) / (within / 57), rel=1e-6)


def test_treatment_describes_its_rows_once_before_and_once_after(spark, monkeypatch):
    from marketweave.operators import outliers as ol
    from marketweave.plans import q_outliers as qo

    calls, describe = [], ol.describe_outliers
    monkeypatch.setattr(ol, "describe_outliers", lambda df, cols: calls.append(cols) or describe(df, cols))
    assert qo.outlier_auto_treatment(spark, "/root/testdata/sf0.001").count() == 3
    assert len(calls) == 2
