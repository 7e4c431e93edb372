"""Chronological cross-validation from sums of products against fits on the rows."""

import datetime

import numpy as np
import pytest

from marketweave.operators import quality as ql


def rows_of(n=360):
    rng = np.random.default_rng(3)
    a, b, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 0.4 * a + noise
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=int(i)) for i in range(n)]
    return days, np.column_stack([a, b, y + 0.05 * rng.normal(size=n), 5 * y]), y


def folds(x, y, count=5):
    """Expanding fits over equal stretches, row by row."""
    edges = [int(np.floor(np.quantile(np.arange(len(y)), k / (count + 1)))) + 1 for k in range(1, count + 1)] + [len(y)]
    out = []
    for start, end in zip(edges, edges[1:]):
        w = np.column_stack([np.ones(start), x[:start]])
        b = np.linalg.lstsq(w, y[:start], rcond=None)[0]
        out.append(((y[start:end] - np.column_stack([np.ones(end - start), x[start:end]]) @ b) ** 2).mean())
    return np.array(out)


def test_leaks_are_caught_and_clean_features_are_not(spark):
    days, x, y = rows_of()
    names = ["a", "b", "signal"]
    data = [(d, *map(float, r[:3]), float(t)) for d, r, t in zip(days, x, y)] + [(days[5], None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (days[9], float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "day date, a double, b double, signal double, y double")
    got = {r["feature"]: r for r in ql.leakage_by_time(df, "y", names, "day").collect()}
    assert {c: r["leaks"] for c, r in got.items()} == {"a": 0, "b": 0, "signal": 1}
    full = folds(x[:, :3], y)
    for i, c in enumerate(names):
        assert got[c]["cv_mse"] == pytest.approx(full.mean(), rel=1e-6) and got[c]["cv_mse_std"] == pytest.approx(full.std(), rel=1e-6)
        assert got[c]["mse_without"] == pytest.approx(folds(np.delete(x[:, :3], i, axis=1), y).mean(), rel=1e-6)


def test_names_copies_and_empty_tables(spark):
    days, x, y = rows_of(60)
    df = spark.createDataFrame([(d, float(r[1]), float(r[3]), float(t)) for d, r, t in zip(days, x, y)], "day date, next_open double, copy double, y double")
    got = {r["feature"]: (r["suspicious_name"], r["equals_target"], r["leaks"]) for r in ql.leakage_by_time(df, "y", ["next_open", "copy"], "day").collect()}
    assert got == {"next_open": (1, 0, 1), "copy": (0, 1, 1)}
    assert ql.leakage_by_time(df.limit(0), "y", ["copy"], "day").collect() == []
