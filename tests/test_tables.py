"""Quantiles, profiles, quality, texts, outliers, scaling against hand-made or brute-force values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketweave.functions import datetimes as dt
from marketweave.functions import scalar as sc
from marketweave.functions import text as tx
from marketweave.operators import anomalies as an
from marketweave.operators import evaluate as ev
from marketweave.operators import integrate as ig
from marketweave.operators import outliers as ol
from marketweave.operators import profile as pf
from marketweave.operators import quality as ql
from marketweave.operators import scaling as scl
from marketweave.operators.quantiles import exact_quantiles
from marketweave.operators.skew import join_key_values


@pytest.mark.parametrize("values", [np.arange(1000.0), np.repeat([1.0, 2.0, 2.0, 9.0], 250), np.random.default_rng(0).normal(0, 1, 1000).round(2)])
def test_quantiles_without_sorting_everything(spark, values):
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(1).permutation(values)}))
    want = np.quantile(values, probs)
    np.testing.assert_allclose(exact_quantiles(df, ["v"], probs, limit=50)["v"], want, rtol=1e-12)
    np.testing.assert_allclose(exact_quantiles(df, ["v"], probs)["v"], want, rtol=1e-12)


def test_numeric_profile_follows_pandas(spark):
    x = pd.Series([1.0, 2, 2, 3, 50, -4, 0, 8])
    row = pf.numeric_profile(spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    assert abs(row["skewness"] - x.skew()) < 1e-9 and abs(row["kurtosis"] - x.kurtosis()) < 1e-9
    assert row["outliers"] == 1 and row["zeros"] == 1 and row["negatives"] == 1


def test_key_correlations_with_gaps(spark):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.normal(size=(40, 3)), columns=["a", "b", "c"])
    wide.loc[3:9, "b"] = np.nan
    long = wide.reset_index().melt("index").dropna()
    out = pf.key_correlations(spark.createDataFrame(long), "variable", "index", "value", ["a", "b", "c"], None).toPandas()
    for _, r in out.iterrows():
        assert abs(r["correlation"] - wide[r["a"]].corr(wide[r["b"]])) < 1e-9


def test_hot_key_join_keeps_every_row(spark):
    rows = spark.range(3000).withColumn("k", F.when(F.col("id") < 1000, 0).otherwise(F.col("id")))
    vals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    out = join_key_values(rows, vals, ["k"], "n")
    assert out.count() == 3000 and out.filter("m < id").count() == 0


def test_duplicates_and_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "7")], "x int, s string")
    assert pf.duplicate_rows(df).first()["duplicates"] == 1
    row = ql.quality_scores(df, "t").first()
    assert row["missing_cells"] == 1 and row["mixed_columns"] == 1
    assert row["quality_score"] == 50 and row["simple_score"] == 67


def test_type_sample(spark):
    df = spark.createDataFrame(
        [(str(i), f"Name{i}", str(25 + 5 * i), "true" if i % 2 else "false", str(50000.5 + 1000 * i), f"2023-0{i}-01") for i in range(1, 6)],
        "id string, name string, age string, is_active string, salary string, joined string",
    )
    got = {r["column"]: r["detected_type"] for r in ql.type_scores(df).collect()}
    assert got == {"id": "integer", "name": "text", "age": "integer", "is_active": "boolean", "salary": "float", "joined": "datetime"}
    out = ql.convert_automatically(df)
    assert dict(out.dtypes)["joined"] == "timestamp" and dict(out.dtypes)["is_active"] == "boolean"


def test_dates_and_zones(spark):
    rows = ["2024-01-05", "01/05/2024", "2024-01-05 10:11:12", "2024-01-05T10:11:12+0100", "2024-01-05T10:11:12.500000Z", "2024-13-45", "rubbish"]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(dt.parse_datetime(F.col("s")).cast("string")).collect()]
    assert out == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 10:11:12", "2024-01-05 09:11:12", "2024-01-05 10:11:12.5", None, None]
    z = spark.createDataFrame([("a PDT",), ("x +0530",), ("none",)], "s string").select(dt.zone_in_text(F.col("s"))).collect()
    assert [r[0] for r in z] == ["US/Pacific", "UTC", None]


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_text_cleaning(spark):
    assert one(spark, "<p>LONDON - Hello &amp; welcome!</p>\nBy Jane Doe\nBig <b>news</b> (today)", tx.clean_news) == "hello welcome! big news (today)"
    assert one(spark, "u/bob said **sooooo** good :) see [this](http://x.yz/a) can't 😀", tx.clean_social) == "bob said so good see this cannot"
    assert one(spark, "Not good, never not bad! very nice", tx.sentiment_text) == "not good_NEG never not_NEG bad! INT_ nice"
    assert one(spark, "   ", tx.clean_social) is None


def test_text_features(spark):
    df = spark.createDataFrame([("Good good day. Is it? @me #x http://a.b 42",), ("",), (None,)], "t string")
    parts = {**tx.basic_stats(F.col("t")), **tx.linguistic(F.col("t")), **tx.lexicon_sentiment(F.col("t"))}
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    a = rows[0].asDict()
    assert a["word_count"] == 9 and a["unique_words"] == 8 and a["digit_count"] == 2 and a["positive_words"] == 2
    assert a["contains_question"] == a["contains_mention"] == a["contains_hashtag"] == a["contains_url"] == 1
    assert rows[1]["word_count"] == 0 and rows[2]["avg_word_length"] == 0


def test_entity_matching_needs_whole_words(spark):
    docs = spark.createDataFrame([(1, "Apple Inc. rose"), (2, "pineapple"), (3, "big apple, inc")], "id int, text string")
    alias = spark.createDataFrame([("AAPL", "apple inc"), ("FRUIT", "apple")], "entity string, alias string")
    got = {tuple(r) for r in ig.match_entities(docs, "text", ["id"], alias).collect()}
    assert got == {(1, "AAPL"), (1, "FRUIT"), (3, "AAPL"), (3, "FRUIT")}


def test_outlier_rules(spark):
    x = np.r_[np.arange(39.0), 500.0]
    df = spark.createDataFrame(pd.DataFrame({"id": range(40), "x": x}))
    for fn, name in ((ol.flag_iqr, "iqr"), (ol.flag_zscore, "zscore"), (ol.flag_mad, "mad")):
        flagged = fn(df, ["x"]).filter(f"x_outlier_{name} = 1").collect()
        assert [r["id"] for r in flagged] == [39]
    assert ol.winsorize(df, ["x"]).agg(F.max("x")).first()[0] == 37.0
    assert ol.null_outliers(df, ["x"]).filter("x is null").count() == 1
    assert ol.flag_mad(df.withColumn("x", F.lit(3.0)), ["x"]).agg(F.sum("x_outlier_mad")).first()[0] == 0


def test_scalers_are_reversible(spark):
    df = spark.createDataFrame(pd.DataFrame({k: np.random.default_rng(3).gamma(2, 3, 200) - 2 for k in scl.KINDS}))
    p = scl.fit(df, {k: k for k in scl.KINDS})
    acc = scl.inversion_accuracy(scl.invert(scl.transform(df, p), p), scl.KINDS).collect()
    assert all(r["max_error"] < 1e-8 for r in acc)
    flat = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert scl.transform(flat, scl.fit(flat, {"x": "minmax"})).first()["x_scaled"] == 0


def test_yeo_johnson_both_ways(spark):
    df = spark.createDataFrame([(float(v),) for v in (-5, -0.5, 0, 0.5, 5)], "x double")
    for lam in (0.0, 0.5, 1.0, 2.0, -0.7):
        back = df.select("x", sc.inverse_yeo_johnson(sc.yeo_johnson(F.col("x"), lam), lam).alias("y")).collect()
        assert all(abs(r["x"] - r["y"]) < 1e-9 for r in back)


def brute_noise(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= m
    return ~(core | (d & core[None]).any(1))


@pytest.mark.parametrize("salts", [None, 3])
def test_density_noise_is_exact(spark, salts):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.3, (80, 2)), rng.uniform(-4, 4, (60, 2)), np.repeat([[2.0, 2.0]], 6, 0)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    out = an.dbscan_noise(df, ["a", "b"], ["id"], 0.5, 5, salts).toPandas().sort_values("id")
    assert (out["outlier_dbscan"].to_numpy() == brute_noise(x, 0.5, 5)).all()


def test_density_noise_in_five_columns(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 0.2, (80, 5)), rng.normal(3, 0.25, (40, 5)), rng.uniform(-4, 4, (30, 5))])
    names = list("abcde")
    out = an.dbscan_noise(spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x)))), names, ["id"], 0.6, 5).toPandas().sort_values("id")
    assert (out["outlier_dbscan"].to_numpy() == brute_noise(x, 0.6, 5)).all()


@pytest.mark.parametrize("n", [5, 40, 30_000])
def test_isolation_forest_samples_alike_at_every_size(spark, n):
    df = spark.range(n).select("id", (F.hash("id") % 1000 / 1000.0).alias("a"), (F.xxhash64("id") % 1000 / 1000.0).alias("b"))
    df = df.unionByName(spark.createDataFrame([(-1, 9.0, 9.0)], "id long, a double, b double"))
    out = an.isolation_forest(df, ["a", "b"], ["id"], trees=20, rows_per_tree=64)
    scores = out.toPandas().set_index("id")["anomaly_score"].astype(float)
    # a row that no small sample holds still ends in the outermost leaves
    assert scores[-1] >= scores.quantile(0.95) if n >= 10 else scores.isna().all()


def test_isolation_forest_finds_the_far_row(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (300, 2)), [[12.0, 12.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(301), "a": x[:, 0], "b": x[:, 1]}))
    out = an.isolation_forest(df, ["a", "b"], ["id"], trees=40, rows_per_tree=64).orderBy(F.desc("anomaly_score")).first()
    assert out["id"] == 300 and out["outlier_isolation_forest"] == 1


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)], "y int, s double")
    assert abs(ev.roc_auc(df, "y", "s").first()[0] - 4.0 / 6) < 1e-12


def test_ranks_of_several_columns_take_few_jobs(spark):
    """Copies, wide ranges, infinities and gaps; all columns share the jobs of a round."""
    rng = np.random.default_rng(4)
    n, inf = 5000, float("inf")
    wide = pd.DataFrame({
        "heavy": rng.lognormal(0, 8, n), "copies": rng.integers(0, 3, n).astype(float), "edges": rng.choice([-1.7e308, -1.0, 0.0, 5e-324, 1e-300, 1.7e308], n),
        "open": rng.choice([-inf, 1.0, 2.5, inf], n), **{f"c{i}": rng.normal(size=n) for i in range(6)},
    })
    df = spark.createDataFrame(wide)
    probs, sc = [0.0, 0.013, 0.25, 0.5, 0.99, 1.0], spark.sparkContext
    sc.setJobGroup("ranks", "quantiles of ten columns")
    got = exact_quantiles(df, list(wide), probs, limit=40)
    jobs = len(sc.statusTracker().getJobIdsForGroup("ranks"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    for c in wide:
        ordered = np.sort(wide[c].to_numpy())
        for p, value in zip(probs, got[c], strict=True):
            at = p * (n - 1)
            a, b = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert value == pytest.approx(a if a == b else a + (b - a) * (at - np.floor(at)), rel=1e-12)
    assert jobs < 60


def test_column_statistics_keep_small_differences(spark):
    """Shapes far from zero are as exact as around it, and infinities, gaps and constants keep their meaning."""
    from marketweave.operators import outliers as ol

    rng = np.random.default_rng(5)
    near = np.round(rng.gamma(2.0, 8.0, 20_000)) / 2**20
    wide = pd.DataFrame({"near": near, "far": 1e9 + near, "open": np.where(near > near.mean(), np.inf, near), "same": 0.1, "gaps": np.where(near > 4 / 2**20, near, np.nan)})
    st = ol.column_stats(spark.createDataFrame(wide), list(wide))
    for c, x in (("near", near), ("far", near), ("gaps", wide["gaps"].dropna().to_numpy())):
        x = pd.Series(x)
        assert (st[c].n, st[c].std, st[c].skew, st[c].kurt) == (len(x), *(pytest.approx(v, rel=1e-6) for v in (x.std(), x.skew(), x.kurt())))
    assert (st["same"].low, st["same"].high, st["same"].std, st["same"].skew, st["same"].kurt) == (0.1, 0.1, 0.0, 0.0, 0.0)
    assert st["open"].high == np.inf and st["open"].low == near.min() and np.isnan(st["open"].skew)
    assert st["far"].median - 1e9 == np.median(near)
