"""Training with chronological validation, evaluation, projection and clustering on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.operators import forests
from marketweave.operators.axis import Axis
from marketweave.operators.evaluate import regression_metrics, roc_auc, weighted_metrics
from marketweave.operators.labels import fold_blocks
from marketweave.operators.profile import near_constant_columns, target_correlation
from marketweave.operators.quantiles import exact_quantiles
from marketweave.session import cut

CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(maxIter=50, regParam=0.01),
    "random_forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=6, seed=42),
    "gradient_boosting": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=42),
    "linear_svm": lambda: LinearSVC(maxIter=50, regParam=0.01),
}
REGRESSORS = {
    "linear": lambda: LinearRegression(maxIter=50),
    "ridge": lambda: LinearRegression(maxIter=50, regParam=1.0, elasticNetParam=0.0),
    "random_forest": lambda: RandomForestRegressor(numTrees=50, maxDepth=6, seed=42),
    "gradient_boosting": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=42),
}


def feature_pipeline(features: Sequence[str], estimator=None, scale: bool = True) -> Pipeline:
    """Assembled, scaled features and the estimator on them, if there is one."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="__raw" if scale else "features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator] if estimator is not None else stages)


def fill_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in features})


def class_weights(df: DataFrame, label: str) -> dict:
    """rows / (classes * rows of the class), from one small aggregate."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    return {k: total / (len(counts) * n) for k, n in counts.items()}


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    w = F.lit(1.0)
    for k, weight in class_weights(df, label).items():
        w = F.when(F.col(label) == k, weight).otherwise(w)
    return df.withColumn("class_weight", w)


METRICS = {"classification": ("accuracy", "precision", "recall", "f1"), "regression": ("mse", "rmse", "mae", "r2")}


def cross_validate(
    df: DataFrame, axis: Axis, feature_sets: dict[str, Sequence[str]], label: str, models: dict, folds: int = 3, kind: str = "classification",
    balanced: bool = False, parallelism: int = 4,
) -> DataFrame:
    """Metrics per (feature_set, model, fold) with training always before testing in every series.

    The rows are written once, with the block that tells the folds they take part in. Forests and
    boosted trees of all folds and sets are grown together, level by level, from the same binned
    blocks (``forests``). The other models see the columns scaled by mean and deviation of the training
    rows, which one pass finds for all folds. ``parallelism``
    jobs run at a time, each of them distributed. Accuracy of classes is 0 where no row is tested,
    errors are NaN there.
    """
    spark = df.sparkSession
    every = sorted({c for cols in feature_sets.values() for c in cols})
    base = fill_features(df.dropna(subset=[label]), every).select(*dict.fromkeys([*axis.keys, *axis.order, *every, label])).withColumn(label, F.col(label).cast("double"))
    rows = cut(fold_blocks(base, axis, folds, "__block"))
    names, empty = METRICS[kind], 0.0 if kind == "classification" else float("nan")
    sides = lambda fold: (rows.filter(F.col("__block") <= fold), rows.filter(F.col("__block") == fold + 1))
    settings = {name: s for name, build in models.items() if (s := forests.Settings.of(build())) and s.classes == (kind == "classification") and not (balanced and s.boosted)}

    def measured(scored: DataFrame) -> tuple[float, ...]:
        m = (weighted_metrics if kind == "classification" else regression_metrics)(scored, label, "prediction").first()
        return tuple(float(m[k]) if m[k] is not None else empty for k in names)

    def fitted(build, train: DataFrame, test: DataFrame) -> tuple[float, ...]:
        est = build().setLabelCol(label).setFeaturesCol("features")
        if "class_weight" in train.columns and est.hasParam("weightCol"):
            est = est.setWeightCol("class_weight")
        return measured(est.fit(train).transform(test))

    found = {}
    with ThreadPoolExecutor(parallelism) as pool:
        # one wrapper per call: each carries its own copy of the caller's job properties
        start = lambda f, *a: pool.submit(inheritable_thread_target(spark)(f), *a)
        grown = []
        if settings:
            size = rows.agg(F.count_if(F.col("__block") < folds).alias("n"), F.max(label).alias("top")).first()
            weights = {f: class_weights(sides(f)[0], label) for f in range(folds)} if balanced else {}
        for bins in sorted({s.bins for s in settings.values()}):
            ends = forests.cuts(rows, every, "__block", range(folds), bins)
            blocks = forests.blocks(rows, every, label, "__block", [*axis.keys, *axis.order], ends, forests.tasks(spark, size["n"])).persist(StorageLevel.MEMORY_AND_DISK)
            for name, s in settings.items():
                if s.bins == bins:
                    classes = int(size["top"] or 0) + 1 if s.classes and not s.boosted else 0
                    given = {f: [w.get(float(k), 0.0) for k in range(int(size["top"] or 0) + 1)] for f, w in weights.items()}
                    fits = {(set_name, f): forests.Fit(f, [every.index(c) for c in cols], classes, given.get(f)) for f in range(folds) for set_name, cols in feature_sets.items()}
                    grown.append((name, s, fits, ends, blocks, start(forests.grow_boosted if s.boosted else forests.grow_forests, blocks, list(fits.values()), s, bins)))
        others = {name: build for name, build in models.items() if name not in settings}
        jobs = {}
        of = lambda f, c: F.when(F.col("__block") <= f, F.col(c))
        moments = rows.agg(*[m(of(f, c)).alias(f"{k}{f}_{c}") for f in range(folds) for c in every for k, m in (("mean", F.avg), ("std", F.stddev_samp))]).first() if others else None
        for fold in range(folds) if others else ():
            train, test = sides(fold)
            if balanced:
                train = balanced_weights(train, label)
            scaled = {c: (F.col(c) - F.lit(moments[f"mean{fold}_{c}"])) * F.lit(1 / s if (s := moments[f"std{fold}_{c}"]) else 0.0) for c in every}
            for set_name, cols in feature_sets.items():
                # linear models read their input twice and keep blocks of their own, so it is not kept as well
                vector = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
                pair = [vector.transform(side.withColumns(scaled)).select("features", label, *[c for c in ("class_weight",) if c in side.columns]) for side in (train, test)]
                jobs |= {(set_name, name, fold): start(fitted, build, *pair) for name, build in others.items()}
        for name, s, fits, ends, _, growth in grown:
            growth.result()
            for (set_name, fold), fit in fits.items():
                scored = forests.scored(sides(fold)[1], every, label, fit, s, ends[fold])
                jobs[set_name, name, fold] = start(measured, scored)
        found |= {key: job.result() for key, job in jobs.items()}
        for blocks in {id(g[4]): g[4] for g in grown}.values():
            blocks.unpersist()
    out = [(set_name, name, fold, *found[set_name, name, fold]) for fold in range(folds) for set_name in feature_sets for name in models]
    return spark.createDataFrame(out, "feature_set string, model string, fold int, " + ", ".join(f"{n} double" for n in names))


def select_features(df: DataFrame, target: str, cols: Sequence[str], k: int) -> list[str]:
    """Drop constant columns, then the k with the largest absolute correlation to the target."""
    flat = set(near_constant_columns(df, cols))
    kept = [c for c in cols if c not in flat]
    return [r["feature"] for r in target_correlation(df, target, kept, k).collect()]  # k rows


def score_new_rows(model: PipelineModel, df: DataFrame, features: Sequence[str], medians: dict[str, float]) -> DataFrame:
    """Columns the model expects but the table lacks become 0, nulls the training median."""
    aligned = df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c) or 0.0))) if c in df.columns else F.lit(0.0) for c in features}
    )
    return model.transform(aligned)


def training_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return {c: q[0] or 0.0 for c, q in exact_quantiles(df, list(features), [0.5]).items()}


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(features, imp)], "feature string, importance double")


# -- projection and clusters ------------------------------------------------------------------


def to_vectors(df: DataFrame, pk: str, array: str) -> DataFrame:
    return df.select(pk, array_to_vector(F.col(array).cast("array<double>")).alias("__raw"))


def standardised(df: DataFrame) -> DataFrame:
    return StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True).fit(df).transform(df)


def principal_components(df: DataFrame, size: int, k: int | None = None):
    """Fitted projection of the standardised vectors on k (default all) components."""
    return PCA(k=k or size, inputCol="features", outputCol="pca").fit(df)


def components_for(model, spark, levels: Sequence[float] = (0.80, 0.85, 0.90, 0.95, 0.99)) -> DataFrame:
    """Number of components that reach each share of variance."""
    shares, total, rows = model.explainedVariance.toArray(), 0.0, []
    cumulative = []
    for v in shares:
        total += float(v)
        cumulative.append(total)
    for level in levels:
        rows.append((level, next((i + 1 for i, c in enumerate(cumulative) if c >= level - 1e-12), len(cumulative))))
    return spark.createDataFrame(rows, "variance double, components int")


def loadings(model, spark, names: Sequence[str], component: int = 0) -> DataFrame:
    pc = model.pc.toArray()
    return spark.createDataFrame([(n, float(pc[i, component]), abs(float(pc[i, component]))) for i, n in enumerate(names)], "feature string, loading double, strength double")


def cluster(df: DataFrame, k: int = 3, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows with their cluster, and one row with silhouette and Calinski-Harabasz score."""
    model = KMeans(k=k, seed=42, featuresCol=features, predictionCol="cluster").fit(df)
    scored = cut(model.transform(df))  # read by every score and by the caller
    centers = [c.tolist() for c in model.clusterCenters()]
    silhouette = ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(scored)
    v = vector_to_array(features)
    dims = len(centers[0])
    center_of = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), F.col("cluster") + 1)
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    parts = scored.withColumn("__v", v).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(sq(F.col("__v"), center_of)).alias("within"), F.array(*[F.sum(F.col("__v")[i]) for i in range(dims)]).alias("sums")
    ).collect()  # one row per cluster
    n, within = sum(p["n"] for p in parts), sum(p["within"] for p in parts)
    whole = [sum(p["sums"][i] for p in parts) / n for i in range(dims)]
    between = sum(p["n"] * sum((x - m) ** 2 for x, m in zip(centers[p["cluster"]], whole)) for p in parts)
    ch = (between / (k - 1)) / (within / (n - k)) if within else float("nan")
    return scored, df.sparkSession.createDataFrame([(k, float(silhouette), float(ch))], "k int, silhouette double, calinski_harabasz double")


def mlp(layers: Sequence[int]):
    return MultilayerPerceptronClassifier(layers=list(layers), maxIter=60, seed=42)


__all__ = [
    "CLASSIFIERS", "REGRESSORS", "balanced_weights", "class_weights", "cluster", "components_for", "cross_validate", "importances", "loadings", "mlp",
    "principal_components", "roc_auc", "score_new_rows", "select_features", "standardised", "to_vectors", "training_medians",
]
