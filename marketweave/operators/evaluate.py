"""Metrics of predictions as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions.num import sdiv


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts. Every count goes once
    to its label and once to its prediction, so the rows, which may be a model's, are read once."""
    cm = confusion(df, label, predicted)
    hit = F.coalesce(F.col("label") == F.col("predicted"), F.lit(False))
    sides = cm.select("n", hit.alias("hit"), F.posexplode(F.array("label", "predicted")).alias("side", "class"))
    total = lambda which: F.sum(F.when(which & F.col("class").isNotNull(), F.col("n")).otherwise(0))
    true = F.col("side") == 0
    j = sides.groupBy("class").agg(total(true).alias("support"), total(true & F.col("hit")).alias("tp"), total(~true).alias("guessed")).fillna(0)
    p = F.coalesce(sdiv("tp", "guessed"), F.lit(0.0))
    rc = F.coalesce(sdiv("tp", "support"), F.lit(0.0))
    return j.select("class", p.alias("precision"), rc.alias("recall"), F.coalesce(sdiv(2 * p * rc, p + rc), F.lit(0.0)).alias("f1"), "support", "tp")


def weighted_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    rep = class_report(df, label, predicted)
    w = lambda c: sdiv(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return rep.agg(
        sdiv(F.sum("tp"), F.sum("support")).alias("accuracy"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"),
        F.sum("support").alias("rows"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve with half credit for ties.

    Rows are first counted per distinct score; those counts are ranked in range partitions, so
    no task holds all scores.
    """
    from pyspark.sql import Window

    from marketweave.session import cut

    counts = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    parts = cut(counts.repartitionByRange("s").withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.sum("neg").alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("__p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.join(before, "__p").withColumn("below", F.col("o") + inside)
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return ranked.agg(sdiv(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    a = F.col(actual)
    sst = F.var_pop(F.when(F.col(predicted).isNotNull(), a)) * F.count(e)
    return df.groupBy(*groups).agg(
        F.count(e).alias("rows"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - sdiv(F.sum(e * e), sst)).alias("r2"),
    )


def uplift(results: DataFrame, keys: Sequence[str], metrics: Sequence[str], base: str = "stock_only", other: str = "integrated") -> DataFrame:
    """Difference of metrics between two feature sets, one row per remaining key."""
    pick = lambda m, which: F.max(F.when(F.col("feature_set") == which, F.col(m)))
    return results.groupBy(*keys).agg(*[(pick(m, other) - pick(m, base)).alias(f"{m}_uplift") for m in metrics])


def overfit_flag(train: str = "train_accuracy", test: str = "test_accuracy"):
    return ((F.col(train) > 0.95) & (F.col(train) - F.col(test) > 0.1)).cast("int")


def blend(predictions: DataFrame, pk: Sequence[str], probability: str = "probability", weight: str | None = None) -> DataFrame:
    """Mean (or weighted mean) of several models' probabilities per row, class at 0.5."""
    p = F.avg(probability) if weight is None else sdiv(F.sum(F.col(probability) * F.col(weight)), F.sum(weight))
    out = predictions.groupBy(*pk).agg(p.alias("probability"))
    return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
