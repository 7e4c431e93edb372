"""Null, NaN, microsecond and zero cases of the statistics, and the rules with fixed numbers."""

import html
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketweave.functions import datetimes as dt
from marketweave.functions import text as tx
from marketweave.operators import backtest as bt
from marketweave.operators import outliers as ol
from marketweave.operators import profile as pf
from marketweave.operators import quality as ql
from marketweave.operators import scaling as scl
from marketweave.operators import series as s
from marketweave.operators.axis import Axis
from marketweave.operators.quantiles import exact_quantiles
from marketweave.operators.textops import text_kind

BARS = Axis(("key",), ("id",), bounded=True)
BLOCKS = Axis(("key",), ("ts", "id"), bounded=False, bucket="hour", block_rows=5)


@pytest.mark.parametrize("axis", [BARS, BLOCKS])
def test_exponential_means_over_nulls_follow_pandas(spark, axis):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(300) < 0.3, np.nan, 50 + np.cumsum(rng.normal(size=300)))
    x[:3] = np.nan
    cases = {"a": [None, 10.0, 10.0], "b": [10.0, None, 20.0], "c": [None if math.isnan(v) else float(v) for v in x], "d": [None, None]}
    rows = [(k, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=20 * i)).to_pydatetime(), v) for k, values in cases.items() for i, v in enumerate(values)]
    out = s.exponential_averages(spark.createDataFrame(rows, "key string, id long, ts timestamp, close double"), axis, spans=(1, 3, 12)).toPandas()
    for k, values in cases.items():
        got = out[out["key"] == k].sort_values("id")
        for n in (1, 3, 12):
            want = pd.Series(values, dtype=float).ewm(span=n, adjust=False).mean()
            np.testing.assert_allclose(got[f"ema_{n}"].astype(float), want, rtol=1e-9, equal_nan=True)


def test_statistics_leave_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])["v"] == [2.0]
    row = pf.numeric_profile(df).first()
    assert (row["count"], row["mean"], row["max"]) == (2, 2.0, 3.0)
    assert [r.v for r in ql.impute(df, "mean").collect()] == [1.0, 2.0, 2.0, 3.0]
    many = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(1e6,), (float("nan"),)], "v double")
    for flagged, name in ((ol.flag_iqr, "iqr"), (ol.flag_zscore, "zscore"), (ol.flag_mad, "mad")):
        got = {str(r.v): r[f"v_outlier_{name}"] for r in flagged(many, ["v"]).collect()}
        assert got["1000000.0"] == 1 and got["nan"] == 0


def test_times_a_microsecond_apart_are_different_rows(spark):
    df = spark.sql("select timestamp_micros(1) t, 0D v, 1 k union all select timestamp_micros(2), 0D, 2 union all select timestamp_micros(1), -0D, 3")
    assert pf.drop_duplicate_rows(df, ["t", "v"], ["k"]).count() == 2
    assert tuple(pf.duplicate_rows(df.drop("k")).first()) == (3, 1)


def test_cumulative_return_through_zero_and_signs(spark):
    prices = [10.0, 0.0, 0.0]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(prices)] + [("b", 0, 10.0), ("b", 1, -5.0), ("b", 2, 20.0)], "key string, id long, close double")
    got = {(r["key"], r["id"]): r.cumulative_return for r in s.cumulative_return(df, BARS).collect()}
    assert got["a", 0] == 0 and got["a", 1] == -1 and got["a", 2] == -1
    assert got["b", 1] == pytest.approx(-1.5) and got["b", 2] == pytest.approx(1.0)


def test_character_references(spark):
    texts = ["It&#8217;s &eacute;t&eacute; &#x27;x&#x27; &middot; &amp;lt; &copy", None, "plain"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.unescape(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_date_formats_and_zone_words(spark):
    texts = ["2025-01-31T10:00:00+09:00", "2025-01-31T10:00:00.123Z", "2025-01-31T10:00:00.5-0100", "2025-01-31T10:00:00Z", "junk", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(dt.parse_datetime(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS").alias("p")).collect()
    assert [r.p for r in rows] == ["2025-01-31 01:00:00.000", "2025-01-31 10:00:00.123", "2025-01-31 11:00:00.500", "2025-01-31 10:00:00.000", None, None]
    zones = spark.createDataFrame([("none",)] * 500 + [("9 am Pacific",)] * 3 + [("EST",)], "t string")
    assert dt.dominant_zone(zones, "t") == "US/Pacific"


def test_date_columns_are_found_behind_many_nulls(spark):
    df = spark.range(3000).select(F.when(F.col("id") >= 1500, F.lit("2024-05-06")).alias("created"), F.lit("5").alias("counts"), F.lit("2024-01-01").alias("ts"))
    assert ql.datetime_candidates(df.coalesce(1)) == ["created", "ts"]


def test_scaling_rules(spark):
    rng = np.random.default_rng(1)
    n = 400
    data = {
        "two": rng.integers(0, 2, n) * 500.0, "percent": rng.uniform(0, 100, n) ** 3 / 1e4, "skewed": rng.pareto(1.5, n) * 1000, "normal": rng.normal(1000, 10, n),
        "zeros": np.where(rng.random(n) < 0.04, 200.0 + rng.random(n), 0.0), "lean": 200 + rng.gamma(1.5, 50, n), "negative": rng.normal(0, 300, n).clip(-500, 500),
    }
    plan = scl.recommend(spark.createDataFrame(pd.DataFrame(data)), list(data))
    assert plan["two"] == plan["percent"] == "minmax" and plan["skewed"] == plan["zeros"] == "power"
    assert plan["normal"] == plan["negative"] == "standard" and plan["lean"] == "robust"


def test_outlier_kinds_and_plan(spark):
    values = [float(i % 10) for i in range(95)] + [100.0] * 5
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, one double")
    got = {r.column: r for r in ol.describe_outliers(df, ["v", "one"]).collect()}
    assert got["v"].severity == "low" and got["v"].kind == "skewness" and got["one"].severity == "none" and got["one"].kind == "general"
    plan = ol.treatment_plan(ol.describe_outliers(df, ["v", "one"]))
    assert plan == {"winsorize": [], "cap": [], "log": ["v"], "impute": []} and list(plan) == ["winsorize", "cap", "log", "impute"]
    assert [ol.severity(x) for x in (0, 0.05, 0.051, 0.1, 0.11)] == ["none", "low", "medium", "medium", "high"]
    none = ol.describe_outliers(spark.createDataFrame([], "v double"), ["v"])
    assert none.collect() == []


def test_kinds_of_text_columns():
    kinds = {"title": "title", "subject": "title", "text": "content", "body": "content", "reddit_post": "social", "abstract": "summary", "feedback": "sentiment"}
    assert {k: text_kind(k, {}) for k in kinds} == kinds
    assert text_kind("x", {"has_mentions": 1}) == "social" and text_kind("x", {"avg_words": 60, "avg_chars": 300}) == "content"
    assert text_kind("x", {"avg_words": 30, "avg_chars": 180}) == "general"


def test_buying_a_short_back(spark):
    rows = [("a", 1, "SELL", 5, 10.0), ("a", 2, "BUY", 5, 8.0), ("b", 1, "SELL", 5, 10.0), ("b", 2, "BUY", 8, 8.0)]
    book = bt.keep_positions(spark.createDataFrame(rows, "s string, day int, action string, quantity long, price double"), ["s"], ["day"])
    got = {(r.s, r.day): (r.position, r.avg_price, r.pnl) for r in book.collect()}
    assert got["a", 2] == (0, 0.0, 9.0) and got["b", 2] == (3, 8.0, 9.0)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from marketweave.session import shared_dir

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_normal_scores_and_back(spark):
    from statistics import NormalDist

    z = [-8.0, -6.5, -5.2, -3.0, -1.0, -1e-9, 0.0, 0.3, 2.5, 5.2, 6.9, 9.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", scl.normal_cdf(F.col("z")).alias("u"), scl._ppf(scl.normal_cdf(F.col("z"))).alias("back")).collect()
    for r in rows:
        assert abs(r.u - NormalDist().cdf(r.z)) < 1e-13
        assert abs(r.z) > 5.2 or abs(r.back - r.z) < 1e-7
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in (*rng.gamma(2, 30, 500), *[7.0] * 100, 0.0)] + [(None,)], "v double")
    p = scl.fit(df, {"v": "quantile"}, output="normal")
    out = scl.invert(scl.transform(df, p), p)
    assert out.where("v IS NULL").first()["v_restored"] is None
    row = scl.inversion_accuracy(out, ["v"]).first()
    assert row["is_exact"] == 1 and row["max_error"] < 1e-7
