"""Column and table profiles. Each is one wide aggregate turned into one row per column."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.functions.num import datetime_columns, nan_to_null, numeric_columns, sample_kurtosis, sample_skew, sdiv, string_columns
from marketweave.operators.quantiles import exact_quantiles
from marketweave.operators.skew import row_digest


def is_missing(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return (F.col(c).isNull() | F.isnan(c)) if floating else F.col(c).isNull()


def _per_column(df: DataFrame, cols: Sequence[str], metrics) -> DataFrame:
    """One aggregate over the table, then one row per column. ``metrics(c)`` lists aliased aggregates."""
    entries = [F.struct(F.lit(c).alias("column"), *metrics(c)) for c in cols]
    return df.agg(F.array(*entries).alias("__m")).select(F.inline("__m"))


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])

    def metrics(c: str) -> list[Column]:
        x = nan_to_null(c)
        n = F.count(x)
        q1, med, q3 = q[c]
        lo = None if q1 is None else q1 - 1.5 * (q3 - q1)
        hi = None if q1 is None else q3 + 1.5 * (q3 - q1)
        out = F.count_if((x < F.lit(lo)) | (x > F.lit(hi)))
        return [
            n.alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.var_samp(x).alias("variance"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            (F.max(x) - F.min(x)).alias("range"),
            F.lit(med).cast("double").alias("median"),
            sample_skew(F.skewness(x), n).alias("skewness"),
            sample_kurtosis(F.kurtosis(x), n).alias("kurtosis"),
            F.count_if(x == 0).alias("zeros"),
            F.count_if(x < 0).alias("negatives"),
            F.count_if(F.abs(x) == float("inf")).alias("infinite"),
            F.lit(q1).cast("double").alias("q1"),
            F.lit(q3).cast("double").alias("q3"),
            F.lit(None if q1 is None else q3 - q1).cast("double").alias("iqr"),
            out.alias("outliers"),
            (sdiv(out, n) * 100).alias("outlier_pct"),
        ]

    return _per_column(df, cols, metrics)


def string_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or string_columns(df))

    def metrics(c: str) -> list[Column]:
        s = F.trim(F.col(c))
        return [
            F.count(c).alias("count"),
            F.count_distinct(s).alias("distinct"),
            F.avg(F.length(s)).alias("avg_length"),
            F.min(F.length(s)).cast("long").alias("min_length"),
            F.max(F.length(s)).cast("long").alias("max_length"),
            F.count_if(s == "").alias("empty"),
            F.count_if((s == "") & (F.length(c) > 0)).alias("whitespace_only"),
        ]

    return _per_column(df, cols, metrics)


def datetime_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or datetime_columns(df))

    def metrics(c: str) -> list[Column]:
        return [
            F.min(c).cast("timestamp").alias("min"),
            F.max(c).cast("timestamp").alias("max"),
            F.floor((F.unix_timestamp(F.max(c)) - F.unix_timestamp(F.min(c))) / 86400).cast("long").alias("range_days"),
            F.count_if(F.weekday(c) >= 5).alias("weekend"),
            F.count_if(F.weekday(c) < 5).alias("weekday"),
            F.count_if(F.col(c).isNull()).alias("invalid"),
        ]

    return _per_column(df, cols, metrics)


def null_profile(df: DataFrame) -> DataFrame:
    def metrics(c: str) -> list[Column]:
        missing = F.count_if(is_missing(df, c))
        return [missing.alias("nulls"), (sdiv(missing, F.count(F.lit(1))) * 100).alias("null_pct")]

    return _per_column(df, df.columns, metrics)


def distinct_profile(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values and their share. Approximate sketches for wide tables; exact counting
    expands each row once per column."""
    cols = list(cols or df.columns)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return _per_column(
        df, cols, lambda c: [distinct(F.col(c)).alias("distinct"), sdiv(distinct(F.col(c)), F.count(F.lit(1))).alias("unique_ratio")]
    )


def value_counts(df: DataFrame, c: str, k: int | None = 10) -> DataFrame:
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k) if k else counts


def most_common(df: DataFrame, c: str):
    """Mode; the smallest value wins a tie. Counts are combined before they are shuffled."""
    row = df.dropna(subset=[c]).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), c).first()
    return None if row is None else row[0]


def top_share(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    best = value_counts(df.dropna(subset=[c]), c, k).agg(F.sum("n").alias("top"))
    return best.crossJoin(df.agg(F.count(c).alias("total"))).select((sdiv("top", "total") * 100).alias("top_share_pct"))


def category_balance(df: DataFrame, c: str) -> DataFrame:
    return value_counts(df.dropna(subset=[c]), c, None).agg(
        F.count(F.lit(1)).alias("categories"), sdiv(F.stddev_samp("n"), F.avg("n")).alias("balance")
    )


# -- correlation ------------------------------------------------------------------------------


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson correlation of column pairs in one pass: (a, b, correlation)."""
    cols = list(cols or numeric_columns(df))
    pairs = list(pairs or [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]])
    whole = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"))
        for a, b in pairs
    ]
    return df.agg(F.array(*whole).alias("__m")).select(F.inline("__m"))


def strong_pairs(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    return pairs.filter(F.abs("correlation") > threshold)


def strength_label(c: Column) -> Column:
    return F.when(F.abs(c) > 0.7, "strong").when(F.abs(c) > 0.3, "moderate").otherwise("weak")


def interactions(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every pair of the columns, by default of all numeric ones."""
    cols = list(cols or numeric_columns(df))
    pairs = list(itertools.combinations(cols, 2))
    return correlation_pairs(df, cols, pairs).withColumn("strength", strength_label(F.col("correlation")))


def target_correlation(df: DataFrame, target: str, cols: Sequence[str], k: int | None = 20) -> DataFrame:
    out = correlation_pairs(df, cols, [(c, target) for c in cols if c != target]).select(
        F.col("a").alias("feature"), "correlation", F.abs("correlation").alias("strength")
    )
    return out.orderBy(F.desc_nulls_last("strength"), "feature").limit(k) if k else out


def near_constant_columns(df: DataFrame, cols: Sequence[str] | None = None, floor: float = 0.0) -> list[str]:
    cols = list(cols or numeric_columns(df))
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is None or row[c] <= floor]


def key_correlations(df: DataFrame, key: str, at: str, value: str, members: Sequence, threshold: float | None = 0.5) -> DataFrame:
    """Correlation of the series of the given keys, aligned on ``at`` and complete per pair.

    The members become one array per ``at``, so no pairs of rows are formed. Each task adds up
    one members x members matrix of sums, and only those matrices are shuffled.
    """
    members = list(members)
    center = df.agg(F.avg(value)).first()[0] or 0.0
    wide = df.groupBy(at).pivot(key, members).agg(F.first(F.col(value) - center))
    vectors = wide.select(F.array(*[F.col(f"`{m}`").cast("double") for m in members]).alias("v"))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((6, len(members), len(members)))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([np.asarray(v, dtype=float) for v in pdf["v"]])
            have = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += [have.T @ have, x.T @ have, have.T @ x, (x * x).T @ have, have.T @ (x * x), x.T @ x]
        i, j = np.triu_indices(len(members), 1)
        yield pd.DataFrame({"i": i, "j": j, **{n: total[k][i, j] for k, n in enumerate(names)}})

    parts = vectors.mapInPandas(sums, "i long, j long, " + ", ".join(f"{n} double" for n in names))
    s = parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    n = F.col("n")
    corr = sdiv(
        n * F.col("sxy") - F.col("sx") * F.col("sy"),
        F.sqrt(n * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy")),
    )
    label = F.array(*[F.lit(m) for m in members])
    out = s.select(
        F.element_at(label, (F.col("i") + 1).cast("int")).alias("a"), F.element_at(label, (F.col("j") + 1).cast("int")).alias("b"),
        corr.alias("correlation"), n.cast("long").alias("days"),
    )
    return out.filter(F.abs("correlation") > threshold) if threshold is not None else out


# -- distributions ----------------------------------------------------------------------------


def volume_profile(df: DataFrame, key: str = "key", bins: int = 49) -> DataFrame:
    """Volume per equal price bin of each series; a close at the very top falls outside."""
    edges = df.groupBy(key).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    pos = F.floor(sdiv(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")) * bins).cast("int")
    return (
        df.join(edges, key)
        .withColumn("bin", pos)
        .filter(F.col("bin") < bins)
        .groupBy(key, "bin")
        .agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars"))
    )


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Counts per equal-width bin; the largest value belongs to the last bin."""
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    clean = df.dropna(subset=[c])
    if lo is None or lo == hi:
        return clean.groupBy(F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    pos = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return clean.groupBy(pos.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- whole tables -----------------------------------------------------------------------------


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(rows, duplicates): rows beyond the first of each group of equal rows."""
    groups = df.groupBy(row_digest(df, list(cols or df.columns)).alias("__d")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicate_rows(df: DataFrame, cols: Sequence[str], keep_first_by: Sequence[str]) -> DataFrame:
    """Keep the first row of each group of equal rows; min_by combines before the shuffle."""
    best = df.groupBy(row_digest(df, cols).alias("__d")).agg(F.min_by(F.struct(*df.columns), F.struct(*keep_first_by)).alias("__r"))
    return best.select("__r.*")


def missing_rows(df: DataFrame) -> DataFrame:
    """Cells and rows with missing values in one pass."""
    flags = [is_missing(df, c).cast("int") for c in df.columns]
    per_row = flags[0]
    for f in flags[1:]:
        per_row = per_row + f
    n = F.count(F.lit(1))
    return df.select(per_row.alias("m")).agg(
        n.alias("rows"),
        (n * len(flags)).alias("cells"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing_cells"),
        F.count_if(F.col("m") > 0).alias("rows_with_missing"),
        F.count_if(F.col("m") == 0).alias("complete_rows"),
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """Row patterns of missing flags (one digit per column) with their counts."""
    pattern = F.concat(*[is_missing(df, c).cast("int").cast("string") for c in df.columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def missing_correlation(df: DataFrame) -> DataFrame:
    flags = df.select(*[is_missing(df, c).cast("int").alias(c) for c in df.columns])
    return correlation_pairs(flags, df.columns)


def dataset_rollup(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: rows, columns by kind, cells, missing share, average missing share per column."""
    out = None
    for name, df in tables.items():
        m = missing_rows(df).select(
            F.lit(name).alias("dataset"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(len(numeric_columns(df))).alias("numeric_columns"),
            F.lit(len(string_columns(df))).alias("string_columns"),
            F.lit(len(datetime_columns(df))).alias("datetime_columns"),
            "cells",
            "missing_cells",
            (sdiv("missing_cells", "cells") * 100).alias("missing_pct"),
            "complete_rows",
        )
        out = m if out is None else out.unionByName(m)
    return out


def summary_of(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("rows").alias("rows"), F.sum("columns").alias("columns"),
        F.avg("missing_pct").alias("avg_missing_pct"), F.max_by("dataset", F.struct("rows", "dataset")).alias("largest"),
    )


def full_profile(df: DataFrame) -> DataFrame:
    """Everything in long form (section, name, metric, value) for a report sink."""

    def melt(part: DataFrame, section: str, name: Column, skip: Sequence[str]) -> DataFrame:
        values = [c for c in part.columns if c not in skip]
        entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in values])
        return part.select(F.lit(section).alias("section"), name.alias("name"), F.inline(entries))

    parts = [melt(missing_rows(df), "overview", F.lit("table"), ()), melt(duplicate_rows(df), "duplicates", F.lit("table"), ())]
    parts.append(melt(null_profile(df), "missing", F.col("column"), ("column",)))
    if numeric_columns(df):
        parts.append(melt(numeric_profile(df), "numeric", F.col("column"), ("column",)))
    if string_columns(df):
        parts.append(melt(string_profile(df), "string", F.col("column"), ("column",)))
    if datetime_columns(df):
        parts.append(melt(datetime_profile(df), "datetime", F.col("column"), ("column",)))
    if len(numeric_columns(df)) > 1:
        parts.append(melt(interactions(df), "interaction", F.concat_ws(" vs ", "a", "b"), ("a", "b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
