"""Window semantics against pandas, and blocks against whole windows."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketweave.operators import labels as lab
from marketweave.operators import series as s
from marketweave.operators.axis import Axis, apply_stages, number_rows, running

BARS = Axis(("key",), ("ts", "id"), bounded=True)
BLOCKS = Axis(("key",), ("ts", "id"), bounded=False, bucket="hour", block_rows=7)


def frame(n=60, keys=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in keys:
        t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 40, n)), unit="h")
        p = 100 + np.cumsum(rng.normal(0, 2, n)).round(2)
        out.append(pd.DataFrame({"key": k, "ts": t, "id": np.arange(n), "close": p, "high": p + 1, "low": p - 1.5, "volume": rng.integers(1, 100, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=3)).cache()


def collect(sdf):
    return sdf.toPandas().sort_values(["key", "id"]).reset_index(drop=True)


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("axis", [BARS, BLOCKS])
def test_averages_and_ema_follow_pandas(df, pdf, axis):
    out = collect(s.exponential_averages(s.moving_averages(df, axis, periods=(5, 20)), axis, spans=(5, 26)))
    g = pdf.groupby("key")["close"]
    same(out["sma_5"], g.transform(lambda x: x.rolling(5).mean()))
    same(out["sma_20"], g.transform(lambda x: x.rolling(20).mean()))
    for n in (5, 26):
        same(out[f"ema_{n}"], g.transform(lambda x: x.ewm(span=n, adjust=False).mean()))


def test_ema_over_several_segments(spark):
    x = 50 + np.cumsum(np.random.default_rng(5).normal(0, 1, 4000))
    pdf = pd.DataFrame({"key": "a", "ts": pd.date_range("2020-01-01", periods=4000, freq="h"), "id": range(4000), "close": x})
    out = collect(s.exponential_averages(spark.createDataFrame(pdf), BARS, spans=(3, 200)))
    for n in (3, 200):
        same(out[f"ema_{n}"], pd.Series(x).ewm(span=n, adjust=False).mean())


@pytest.mark.parametrize("axis", [BARS, BLOCKS])
def test_macd_rsi_bollinger(df, pdf, axis):
    out = collect(s.bollinger(s.rsi(s.macd(df, axis), axis), axis))
    g = pdf.groupby("key")["close"]
    macd = g.transform(lambda x: x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean())
    same(out["macd"], macd)
    same(out["macd_signal"], macd.groupby(pdf["key"]).transform(lambda x: x.ewm(span=9, adjust=False).mean()))

    def rsi(x):
        d = x.diff()
        return 100 - 100 / (1 + d.where(d > 0, 0).rolling(14).mean() / (-d.where(d < 0, 0)).rolling(14).mean())

    same(out["rsi_14"], g.transform(rsi))
    same(out["bb_upper"], g.transform(lambda x: x.rolling(20).mean() + 2 * x.rolling(20).std()))


def test_rolling_quantiles_and_stochastic(df, pdf):
    out = collect(s.stochastic(s.rolling_features(df, BARS, ["close"], (7,)), BARS))
    g = pdf.groupby("key")["close"]
    same(out["close_rolling_q25_7"], g.transform(lambda x: x.rolling(7).quantile(0.25)))
    same(out["close_rolling_median_7"], g.transform(lambda x: x.rolling(7).median()))
    hh = pdf.groupby("key")["high"].transform(lambda x: x.rolling(14).max())
    ll = pdf.groupby("key")["low"].transform(lambda x: x.rolling(14).min())
    same(out["stoch_k"], (pdf["close"] - ll) / (hh - ll) * 100)


def test_nulls_delay_full_frames(spark):
    pdf = pd.DataFrame({"key": "a", "ts": pd.date_range("2024-01-01", periods=8), "id": range(8), "close": [1.0, 2, None, 4, 5, 6, 7, 8]})
    sdf = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    out = collect(s.moving_averages(sdf, BARS, periods=(3,)))
    same(out["sma_3"], pdf["close"].rolling(3).mean())


def test_blocks_match_whole_windows_with_lookahead(df):
    stage = {"x": lambda f: f.lead("close", 3) - f.lag("close", 2)}
    a = collect(apply_stages(df, BARS, [stage], back=2, ahead=3))
    b = collect(apply_stages(df, BLOCKS, [stage], back=2, ahead=3))
    assert len(a) == len(b)
    same(a["x"], b["x"])


def test_running_and_numbering_in_buckets(df, pdf):
    out = collect(running(df, BLOCKS, {"mx": ("max", F.col("close")), "sm": ("sum", F.col("close"))}))
    g = pdf.groupby("key")["close"]
    same(out["mx"], g.cummax())
    same(out["sm"], g.cumsum())
    rn = collect(number_rows(df, BLOCKS, "rn", size="n"))
    same(rn["rn"], pdf.groupby("key").cumcount())
    assert (rn["n"] == 60).all()


@pytest.mark.parametrize("axis", [BARS, BLOCKS])
def test_fill_both_ways(spark, axis):
    pdf = frame(20)
    pdf.loc[pdf.index % 3 != 1, "volume"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))
    out = collect(s.fill_forward_backward(sdf, axis, ["volume"]))
    same(out["volume"], pdf.groupby("key")["volume"].transform(lambda x: x.ffill().bfill()))


def test_keys_do_not_mix(spark, df, pdf):
    both = collect(s.volatility(df, BARS))
    alone = collect(s.volatility(df.filter("key = 'b'"), BARS))
    same(both[both["key"] == "b"]["volatility_20d"], alone["volatility_20d"])


def test_flat_series(spark):
    pdf = pd.DataFrame({"key": "a", "ts": pd.date_range("2024-01-01", periods=30), "id": range(30), "close": 5.0})
    out = collect(s.bollinger(s.rsi(spark.createDataFrame(pdf), BARS), BARS))
    assert out["rsi_14"].isna().all()
    assert out["bb_position"].isna().all()


def test_labels_drop_the_last_row(df):
    out = collect(lab.next_return(df, BARS))
    assert out.groupby("key").size().tolist() == [59, 59]


def test_folds_and_splits(df):
    folds = lab.expanding_folds(df, BLOCKS, 3).groupBy("key", "fold", "role").count().toPandas()
    assert set(folds[folds["role"] == "test"]["count"]) == {15}
    split = lab.chronological_split(df, BLOCKS, 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 96, "test": 24}


def test_stratified_split_is_exact_and_repeatable(spark):
    sdf = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = lab.stratified_split(sdf, "y", ["id"])
    counts = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert counts[(1, "train")] == 70 and counts[(0, "train")] == 630 and counts[(1, "val")] == 15
    b = lab.stratified_split(sdf.repartition(7), "y", ["id"])
    assert a.exceptAll(b).count() == 0


def test_empty_input_keeps_the_schema(spark, df):
    out = s.macd(s.rsi(df.limit(0), BARS), BARS)
    assert out.count() == 0 and "macd_signal" in out.columns


def test_snapshot_of_short_series(spark):
    pdf = frame(10, ("a",))
    row = s.latest_snapshot(spark.createDataFrame(pdf), BARS).first()
    assert row["rsi"] == 50 and row["atr"] == 0.1 and row["volatility_20d"] == 0.1
    assert abs(row["sma_20"] - pdf["close"].mean()) < 1e-9


def test_drawdown_and_cumulative_return(df, pdf):
    out = collect(s.cumulative_return(s.drawdown(df, BARS), BARS))
    g = pdf.groupby("key")["close"]
    same(out["drawdown"], pdf["close"] / g.cummax() - 1)
    same(out["cumulative_return"], pdf["close"] / g.transform("first") - 1)
