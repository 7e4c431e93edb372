"""Queries for metrics, training, projection and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions.num import r
from marketweave.operators import evaluate as ev
from marketweave.operators import labels as lab
from marketweave.operators import ml
from marketweave.operators import quality as ql
from marketweave.operators import series as s
from marketweave.plans.registry import query
from marketweave.plans.roles import BAR_AXIS, bars, daily_orders, table
from marketweave.session import cut

STOCK = ["daily_return", "volatility_5d", "volatility_20d", "volume_ratio_20", "price_vs_sma_20"]
NEWS = ["news_count", "news_sentiment"]
SETS = {"stock_only": STOCK, "integrated": [*STOCK, *NEWS]}


def training_rows(spark, sf):
    """Labelled feature rows of all keys, written once: every fit reads them several times. Only
    what the fits read is written, so that no window is computed for columns nobody looks at; the
    news are one row per calendar day."""
    b = s.volume_features(s.volatility(bars(spark, sf), BAR_AXIS), BAR_AXIS)
    b = s.average_spreads(b, BAR_AXIS)
    rows = lab.next_return(b, BAR_AXIS).dropna(subset=["volatility_20d"]).join(F.broadcast(daily_orders(spark, sf)), "day", "left")
    return cut(rows.select("key", "day", *STOCK, *NEWS, "target_return", "target_up"))


@query(
    "class_report",
    """WITH c AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT l AS class FROM c UNION SELECT DISTINCT p FROM c),
    m AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE l = class AND p = class), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE l = class), 0) AS su, coalesce((SELECT sum(n) FROM c WHERE p = class), 0) AS gu FROM k)
    SELECT class, round(coalesce(tp / nullif(gu, 0), 0), 6) AS precision, round(coalesce(tp / nullif(su, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(gu + su, 0), 0), 6) AS f1, CAST(su AS BIGINT) AS support FROM m""",
)
def class_report(spark, sf):
    out = ev.class_report(table(spark, sf, "labels"), "quality", "toxic")
    return out.select("class", *[r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "weighted_class_metrics",
    """WITH c AS (SELECT quality AS l, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT l AS class FROM c UNION SELECT DISTINCT p FROM c),
    m AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE l = class AND p = class), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE l = class), 0) AS su, coalesce((SELECT sum(n) FROM c WHERE p = class), 0) AS gu FROM k)
    SELECT round(sum(tp) / sum(su), 6) AS accuracy, round(sum(coalesce(tp / nullif(gu, 0), 0) * su) / sum(su), 6) AS precision, round(sum(coalesce(tp / nullif(su, 0), 0) * su) / sum(su), 6) AS recall,
      round(sum(coalesce(2 * tp / nullif(gu + su, 0), 0) * su) / sum(su), 6) AS f1, CAST(sum(su) AS BIGINT) AS rows FROM m""",
)
def weighted_class_metrics(spark, sf):
    out = ev.weighted_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return out.select(*[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "rows")


_SCORED = "x AS (SELECT d.n_chars AS s, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    "area_under_roc",
    f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x), n AS (SELECT sum(y) AS p, count(*) - sum(y) AS q FROM x)
    SELECT round((sum(rk) FILTER (y = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(q)), 8) AS auc FROM r, n""",
)
def area_under_roc(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return ev.roc_auc(x, "quality", "n_chars").select(r("auc", 8).alias("auc"))


@query(
    "regression_metrics",
    """SELECT l_returnflag, count(*) AS rows, round(avg(power(l_extendedprice - l_quantity * 1500, 2)), 0) AS mse, round(sqrt(avg(power(l_extendedprice - l_quantity * 1500, 2))), 4) AS rmse,
      round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(1 - sum(power(l_extendedprice - l_quantity * 1500, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    out = ev.regression_metrics(li, "l_extendedprice", "guess", ["l_returnflag"])
    return out.select("l_returnflag", "rows", r("mse", 0).alias("mse"), r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"), r("r2").alias("r2"))


@query(
    "blended_predictions",
    """WITH m AS (SELECT event_id, value / (value + 10) AS p, 0.6 AS w FROM events UNION ALL SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0.9 ELSE 0.2 END, 0.4 FROM events)
    SELECT event_id, round(sum(p * w) / sum(w), 6) AS probability, CAST(sum(p * w) / sum(w) >= 0.5 AS INT) AS prediction FROM m GROUP BY 1""",
)
def blended_predictions(spark, sf):
    e = table(spark, sf, "events")
    a = e.select("event_id", (F.col("value") / (F.col("value") + 10)).alias("probability"), F.lit(0.6).alias("w"))
    b = e.select("event_id", F.when(F.col("event_type") == "purchase", 0.9).otherwise(0.2).alias("probability"), F.lit(0.4).alias("w"))
    return ev.blend(a.unionByName(b), ["event_id"], weight="w").withColumn("probability", r("probability"))


@query("classification_by_time_folds")
def classification_by_time_folds(spark, sf):
    models = {k: ml.CLASSIFIERS[k] for k in ("logistic", "linear_svm", "random_forest", "gradient_boosting")}
    return ml.cross_validate(training_rows(spark, sf), BAR_AXIS, SETS, "target_up", models, folds=3)


@query("regression_by_time_folds")
def regression_by_time_folds(spark, sf):
    models = {k: ml.REGRESSORS[k] for k in ("linear", "ridge", "random_forest", "gradient_boosting")}
    return ml.cross_validate(training_rows(spark, sf), BAR_AXIS, SETS, "target_return", models, folds=3, kind="regression")


@query("balanced_classification")
def balanced_classification(spark, sf):
    return ml.cross_validate(training_rows(spark, sf), BAR_AXIS, SETS, "target_up", {k: ml.CLASSIFIERS[k] for k in ("logistic", "random_forest")}, folds=3, balanced=True)


@query("feature_set_uplift")
def feature_set_uplift(spark, sf):
    """What the news add, for every model and fold: class metrics of the classifiers, errors of the
    regressors (a lower error is a negative uplift)."""
    rows, parts = training_rows(spark, sf), []
    for kind, target, models in (("classification", "target_up", ml.CLASSIFIERS), ("regression", "target_return", ml.REGRESSORS)):
        res = ml.cross_validate(rows, BAR_AXIS, SETS, target, models, folds=3, kind=kind)
        parts.append(ev.uplift(res, ["model", "fold"], ml.METRICS[kind]).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@query("leakage_over_time")
def leakage_over_time(spark, sf):
    """Return features of the bars, and one made of the coming return that its name does not give away."""
    rows = training_rows(spark, sf).withColumn("signal", F.col("target_return") * 0.8 + F.pmod(F.hash("key", "day"), F.lit(100)) / 10000.0)
    out = ql.leakage_by_time(rows, "target_return", [*STOCK, "signal"], "day")
    return out.select("feature", "suspicious_name", "equals_target", *[r(c, 9).alias(c) for c in ("cv_mse", "cv_mse_std", "mse_without")], "leaks")


@query("overfitting_check")
def overfitting_check(spark, sf):
    every = ml.fill_features(training_rows(spark, sf), STOCK).withColumn("y", F.col("target_up").cast("double"))
    rows, late = every.filter(F.col("day") < "1999-01-01"), every.filter(F.col("day") >= "1999-01-01")
    model = ml.feature_pipeline(STOCK, ml.CLASSIFIERS["random_forest"]().setLabelCol("y")).fit(rows)
    a = ev.weighted_metrics(model.transform(rows), "y", "prediction").select(F.col("accuracy").alias("train_accuracy"))
    b = ev.weighted_metrics(model.transform(late), "y", "prediction").select(F.col("accuracy").alias("test_accuracy"))
    return a.crossJoin(F.broadcast(b)).withColumn("overfit", ev.overfit_flag())  # one row each


@query("feature_importances")
def feature_importances(spark, sf):
    rows = ml.fill_features(training_rows(spark, sf), STOCK).withColumn("y", F.col("target_up").cast("double"))
    return ml.importances(ml.feature_pipeline(STOCK, ml.CLASSIFIERS["random_forest"]().setLabelCol("y"), scale=False).fit(rows), STOCK, spark)


@query("batch_scoring")
def batch_scoring(spark, sf):
    """Fit on early rows, score the others after a feature was lost."""
    every = training_rows(spark, sf)
    train = every.filter(F.col("day") < "1998-01-01")
    model = ml.feature_pipeline(STOCK, ml.CLASSIFIERS["logistic"]().setLabelCol("y")).fit(ml.fill_features(train, STOCK).withColumn("y", F.col("target_up").cast("double")))
    late = every.filter(F.col("day") >= "1998-01-01").drop("volume_ratio_20")
    return ml.score_new_rows(model, late, STOCK, ml.training_medians(train, STOCK)).select("key", "day", "prediction")


@query("selected_features")
def selected_features(spark, sf):
    rows = training_rows(spark, sf)
    return spark.createDataFrame([(c,) for c in ml.select_features(rows, "target_return", SETS["integrated"], 3)], "feature string")


def _vectors(spark, sf):
    return ml.standardised(ml.to_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding"))


def _size(spark, sf) -> int:
    return table(spark, sf, "embeddings").select(F.size("embedding")).first()[0]


@query("variance_of_components")
def variance_of_components(spark, sf):
    return ml.components_for(ml.principal_components(_vectors(spark, sf), _size(spark, sf)), spark)


@query("first_component_loadings")
def first_component_loadings(spark, sf):
    n = _size(spark, sf)
    return ml.loadings(ml.principal_components(_vectors(spark, sf), n, 3), spark, [f"x{i}" for i in range(n)])


@query("cluster_quality")
def cluster_quality(spark, sf):
    return ml.cluster(_vectors(spark, sf), 3)[1]


@query("regime_clusters")
def regime_clusters(spark, sf):
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    cols = ["daily_return", "volatility_20d", "momentum_20"]
    # written once: scaler, clusters and scores each read the rows anew
    rows = cut(s.regime_vector(bars(spark, sf), BAR_AXIS).select(*cols).dropna())
    vec = VectorAssembler(inputCols=cols, outputCol="__raw").transform(rows)
    vec = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(vec).transform(vec)
    return ml.cluster(vec, 3)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("bars"), F.avg("daily_return").alias("daily_return"), F.avg("volatility_20d").alias("volatility_20d"))


@query("network_on_components")
def network_on_components(spark, sf):
    """A small multilayer network on the first components."""
    v = _vectors(spark, sf)
    parts = ml.principal_components(v, _size(spark, sf), 8).transform(v).join(table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y")), "vec_id")
    classes = int(parts.agg(F.max("y")).first()[0]) + 1
    split = lab.stratified_split(parts, "y", ["vec_id"])
    est = ml.mlp([8, 128, 64, 32, max(classes, 2)]).setFeaturesCol("pca").setLabelCol("y")
    scored = est.fit(split.filter(F.col("split") == "train")).transform(split.filter(F.col("split") != "train"))
    return scored.select("vec_id", "split", "y", "prediction")
