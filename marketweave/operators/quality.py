"""Quality scores, type inference and conversion, missing values, plausibility and repair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions import datetimes as dt
from marketweave.functions import lexicons as lx
from marketweave.functions.num import clip, datetime_columns, flag, inf_to, nan_to_null, numeric_columns, sdiv, string_columns
from marketweave.functions.scalar import to_boolean, to_number
from marketweave.operators import profile as pf
from marketweave.operators.axis import Axis
from marketweave.operators.quantiles import exact_quantiles
from marketweave.operators.series import fill_forward_backward


# -- scores and recommendations ---------------------------------------------------------------


def mixed_type_columns(df: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """String columns and the share of their values that read as numbers, dates, booleans.
    A column is mixed when the share of numbers lies clearly between none and all."""
    cols = string_columns(df)

    def metrics(c: str) -> list[Column]:
        n = F.count(c)
        numbers = F.count_if(to_number(F.col(c)).isNotNull())
        share = F.coalesce(sdiv(numbers, n), F.lit(0.0))
        return [
            n.alias("count"),
            share.alias("numeric_share"),
            F.coalesce(sdiv(F.count_if(dt.parse_datetime(F.col(c), lx.INFERENCE_FORMATS).isNotNull()), n), F.lit(0.0)).alias("datetime_share"),
            F.coalesce(sdiv(F.count_if(to_boolean(F.col(c)).isNotNull()), n), F.lit(0.0)).alias("boolean_share"),
            flag((share > low) & (share < high)).alias("is_mixed"),
        ]

    return pf._per_column(df, cols, metrics)


def quality_scores(df: DataFrame, dataset: str, key_cols: Sequence[str] | None = None) -> DataFrame:
    """One row: nulls, duplicates, mixed columns and the two scores."""
    missing, dup = pf.missing_rows(df), pf.duplicate_rows(df, key_cols).drop("rows")
    mixed = (
        mixed_type_columns(df).agg(F.coalesce(F.sum("is_mixed"), F.lit(0)).alias("mixed_columns"))
        if string_columns(df) else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("mixed_columns"))
    )
    # single rows
    one = missing.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(mixed))
    null_pct = F.coalesce(sdiv("missing_cells", "cells") * 100, F.lit(0.0))
    dup_pct = F.coalesce(sdiv("duplicates", "rows") * 100, F.lit(0.0))
    return one.select(
        F.lit(dataset).alias("dataset"), "rows", "missing_cells", "duplicates", "mixed_columns", null_pct.alias("null_pct"), dup_pct.alias("duplicate_pct"),
        F.greatest(
            F.lit(0), F.round(100 - F.least(null_pct * 2, F.lit(40.0)) - F.least(dup_pct, F.lit(20.0)) - F.least(F.col("mixed_columns") * 5, F.lit(20))).cast("int")
        ).alias("quality_score"),
        F.greatest(F.lit(0), F.floor(100 - F.least(null_pct, F.lit(40.0)) - F.least(dup_pct, F.lit(20.0))).cast("int")).alias("simple_score"),
    )


def recommendations(df: DataFrame) -> DataFrame:
    """(subject, advice): columns with many nulls, mixed columns, duplicate rows."""
    nulls = pf.null_profile(df).select(
        F.col("column").alias("subject"), F.when(F.col("null_pct") > 50, "consider removal").when(F.col("null_pct") > 20, "consider imputation").alias("advice")
    )
    dup = pf.duplicate_rows(df).select(F.lit("table").alias("subject"), F.when(F.col("duplicates") > 0, "has duplicate rows").alias("advice"))
    out = nulls.unionByName(dup)
    if string_columns(df):
        out = out.unionByName(mixed_type_columns(df).select(F.col("column").alias("subject"), F.when(F.col("is_mixed") == 1, "has mixed types").alias("advice")))
    return out.dropna(subset=["advice"])


def missing_advice(df: DataFrame) -> DataFrame:
    return pf.null_profile(df).withColumn(
        "advice",
        F.when(F.col("null_pct") > 50, "remove column").when(F.col("null_pct") > 20, "impute with care").when(F.col("null_pct") > 5, "impute").when(F.col("nulls") > 0, "few gaps"),
    )


# -- types ------------------------------------------------------------------------------------

TYPES = ("integer", "float", "boolean", "datetime", "categorical", "text")


def type_scores(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: a score per type, the best type and its confidence. One aggregate."""
    cols = list(cols or df.columns)
    parsed = {c: f"__s{i}" for i, c in enumerate(cols)}
    parsed.update({c + "/x": f"__x{i}" for i, c in enumerate(cols)})
    df = df.select(*[F.trim(F.col(c).cast("string")).alias(parsed[c]) for c in cols]).select(
        "*", *[to_number(F.col(parsed[c])).alias(parsed[c + "/x"]) for c in cols]
    )

    def metrics(c: str) -> list[Column]:
        s, x = F.col(parsed[c]), F.col(parsed[c + "/x"])
        return [
            F.count(s).alias("n"),
            F.count(x).alias("numbers"),
            F.count_if(x != F.floor(x)).alias("fractions"),
            F.count_if(to_boolean(s).isNotNull()).alias("booleans"),
            F.greatest(*[F.count(dt.try_format(s, f)) for f in lx.INFERENCE_FORMATS]).alias("dates"),
            F.approx_count_distinct(s).alias("distinct"),
            F.avg(F.length(s)).alias("avg_length"),
            F.bool_or(s.contains(" ") ).alias("spaces"),
            F.bool_or(s.rlike("[.,!?;:]")).alias("marks"),
        ]

    m = pf._per_column(df, cols, metrics)
    n = F.col("n")
    num, dates, bools = (F.coalesce(sdiv(c, n), F.lit(0.0)) for c in ("numbers", "dates", "booleans"))
    # a column with fractions must not tie as integer
    whole = F.coalesce(sdiv(F.col("numbers") - F.col("fractions"), n), F.lit(0.0))
    ratio = F.coalesce(sdiv("distinct", n), F.lit(0.0))
    fractions = F.col("fractions") > 0
    plus = lambda e, b: F.least(e + b, F.lit(1.0))
    base_text = F.when(F.col("avg_length") > 10, 0.8).when(F.col("avg_length") > 5, 0.6).otherwise(0.3)
    scored = m.select(
        "column", "n", "distinct",
        F.when((num > 0.9) & ~fractions, plus(num, 0.1)).otherwise(whole).alias("integer"),
        F.when((num > 0.8) & fractions, plus(num, 0.1)).otherwise(num).alias("float"),
        F.when((bools > 0.8) & (F.col("distinct") == 2), plus(bools, 0.2)).otherwise(bools).alias("boolean"),
        F.when(dates > 0.9, plus(dates, 0.1)).otherwise(dates).alias("datetime"),
        F.when((ratio < 0.1) & (F.col("distinct") < 100), F.least(1 - ratio, F.lit(0.9)))
        .when((ratio < 0.3) & (F.col("distinct") < 1000), F.greatest(0.8 - ratio * 2, F.lit(0.3))).otherwise(0.1).alias("categorical"),
        F.when(F.col("spaces") & F.col("marks"), plus(base_text, 0.2)).otherwise(base_text).alias("text"),
    )
    best = F.greatest(*[F.col(t) for t in TYPES])
    pick = F.lit(None).cast("string")
    for t in reversed(TYPES):  # the first type wins a tie
        pick = F.when(F.col(t) == best, F.lit(t)).otherwise(pick)
    return scored.withColumns(
        {"detected_type": F.when(n == 0, "unknown").otherwise(pick), "confidence": F.when(n == 0, 0.0).otherwise(F.round(best, 3))}
    )


def converted(c: str, kind: str) -> Column:
    col = F.col(c)
    s = F.trim(col.cast("string"))
    return {
        "integer": lambda: to_number(s).cast("long"),
        "float": lambda: to_number(col),
        "boolean": lambda: to_boolean(col),
        "datetime": lambda: dt.parse_datetime(s, lx.INFERENCE_FORMATS),
        "categorical": lambda: col.cast("string"),
        "text": lambda: col.cast("string"),
    }[kind]().alias(c)


def convert(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Cast columns by {column: type}; values that do not fit become null."""
    return df.select(*[converted(c, mapping[c]) if c in mapping else F.col(c) for c in df.columns])


def mapping_of(scores: DataFrame, threshold: float = 0.7) -> dict[str, str]:
    """One row per column, so collecting is safe."""
    return {r["column"]: r["detected_type"] for r in scores.collect() if r["confidence"] >= threshold and r["detected_type"] in TYPES}


def convert_automatically(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    strings = string_columns(df)
    return convert(df, mapping_of(type_scores(df, strings), threshold)) if strings else df


def type_advice(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """keep / convert / review per column."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fits = {"integer": ("int", "bigint", "smallint"), "float": ("double", "float"), "boolean": ("boolean",), "datetime": ("timestamp", "date"), "categorical": ("string",), "text": ("string",)}
    s = type_scores(df, cols)
    now = F.element_at(F.create_map(*[F.lit(x) for kv in have.items() for x in kv]), F.col("column"))
    ok = F.lit(False)
    for t, names in fits.items():
        ok = ok | ((F.col("detected_type") == t) & F.col("current_type").isin(*names))
    return s.withColumn("current_type", now).select(
        "column", "current_type", "detected_type", "confidence",
        F.when(ok & (F.col("confidence") > 0.8), "keep").when(F.col("confidence") > 0.7, "convert").otherwise("review").alias("action"),
    )


# -- date-time columns ------------------------------------------------------------------------

# Parts of names that suggest a date-time column, and whole names that do.
DATETIME_NAME_PARTS = ("date", "time", "timestamp", "created", "updated", "modified", "published")
DATETIME_NAMES = ("ts", "dt")


def datetime_candidates(df: DataFrame, rate: float = 0.5) -> list[str]:
    """Columns of a date-time type, and string columns with a fitting name of whose values more than
    ``rate`` can be read."""
    typed = datetime_columns(df)
    named = [c for c in string_columns(df) if c.lower() in DATETIME_NAMES or any(p in c.lower() for p in DATETIME_NAME_PARTS)]
    if not named:
        return typed
    row = df.agg(
        *[F.coalesce(sdiv(F.count(dt.parse_datetime(F.col(c))), F.count(c)), F.lit(0.0)).alias(c) for c in named]
    ).first()
    return typed + [c for c in named if row[c] > rate]


def standardise_datetimes(df: DataFrame, cols: Sequence[str], zone: str = "UTC", style: str = "iso") -> tuple[DataFrame, DataFrame]:
    """Parsed, zoned and formatted columns, and success rates per column."""
    parsed = {c: dt.to_zone(F.col(c) if c in datetime_columns(df) else dt.parse_datetime(F.col(c).cast("string")), zone) for c in cols}
    fmt = dt.format_iso if style == "iso" else dt.format_standard
    out = df.withColumns({f"{c}_std": fmt(p) if style in ("iso", "standard") else p for c, p in parsed.items()})
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null_before"), F.count_if(F.col(f"{c}_std").isNull()).alias("null_after"),
            F.coalesce(sdiv(F.count(f"{c}_std"), F.count(c)) * 100, F.lit(0.0)).alias("success_rate"),
        )
        for c in cols
    ]
    return out, out.agg(F.array(*rows).alias("__m")).select(F.inline("__m"))


# -- missing values ---------------------------------------------------------------------------


def impute(df: DataFrame, numeric: str = "median", text: str = "Unknown", axis: Axis | None = None) -> DataFrame:
    """Numbers by median, mean or zero, strings by a word, other columns from the rows before and
    after in their series when an axis is given."""
    nums = [c for c in numeric_columns(df) if axis is None or c not in (*axis.keys, *axis.order)]
    if numeric == "median":
        values = {c: q[0] for c, q in exact_quantiles(df, nums, [0.5]).items()} if nums else {}
    elif numeric == "mean":
        values = df.agg(*[F.avg(nan_to_null(c)).alias(c) for c in nums]).first().asDict() if nums else {}
    else:
        values = dict.fromkeys(nums, 0.0)
    others = [c for c in df.columns if c not in numeric_columns(df) and c not in string_columns(df)]
    out = fill_forward_backward(df, axis, [c for c in others if c not in axis.order]) if axis is not None else df
    return out.withColumns(
        {
            **{c: F.coalesce(F.when(~pf.is_missing(df, c), F.col(c)).cast("double"), F.lit(0.0 if values[c] is None else float(values[c]))) for c in nums},
            **{c: F.coalesce(F.col(c), F.lit(text)) for c in string_columns(df)},
        }
    )


def _value(df: DataFrame, c: str) -> Column:
    return nan_to_null(c) if c in numeric_columns(df) else F.col(c)


def imputation_report(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls, mean and deviation of each column before and after."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return pf._per_column(
            df, cols, lambda c: [F.count_if(pf.is_missing(df, c)).alias(f"nulls_{tag}"), F.avg(_value(df, c)).alias(f"mean_{tag}"), F.stddev_samp(_value(df, c)).alias(f"std_{tag}")]
        )

    return side(before, "before").join(side(after, "after"), "column")


# -- plausibility and repair ------------------------------------------------------------------


def plausible_range(c: str, q1: float, q3: float) -> tuple[float, float]:
    """Allowed range by what the name says, else five quartile distances around the middle."""
    low = c.lower()
    if "sentiment" in low:
        return -1.0, 1.0
    if "score" in low:
        return -100.0, 100.0
    if "market_cap" in low:
        return 0.0, 1e13
    if "ratio" in low:
        return -10.0, 1000.0
    return q1 - 5 * (q3 - q1), q3 + 5 * (q3 - q1)


def plausibility(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    q = exact_quantiles(df, cols, [0.25, 0.75])
    bounds = {c: plausible_range(c, *q[c]) for c in cols if q[c][0] is not None}

    def metrics(c: str) -> list[Column]:
        lo, hi = bounds[c]
        bad = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
        return [
            F.lit(lo).alias("low"), F.lit(hi).alias("high"), bad.alias("implausible"), (sdiv(bad, F.count(c)) * 100).alias("implausible_pct"),
            F.count_if(F.abs(F.col(c)) == float("inf")).alias("infinite"),
        ]

    return pf._per_column(df, list(bounds), metrics)


def repair(df: DataFrame, floors: dict[str, float] | None = None, ceilings: dict[str, float] | None = None, numeric_text: Sequence[str] = ()) -> DataFrame:
    """Floors by column, values above a ceiling to the 99th percentile, numeric strings cast,
    infinities to the median."""
    nums = numeric_columns(df)
    q = exact_quantiles(df.select(*[F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) for c in nums]), nums, [0.5, 0.99])
    out = {}
    for c in nums:
        e = inf_to(F.col(c).cast("double"), q[c][0])
        if c in (ceilings or {}):
            e = F.when(e > ceilings[c], F.lit(q[c][1])).otherwise(e)
        if c in (floors or {}):
            e = clip(e, floors[c])
        out[c] = e
    out.update({c: to_number(F.col(c)) for c in numeric_text})
    return df.withColumns(out)


def leakage_audit(df: DataFrame, target: str, features: Sequence[str], limit: float = 0.999) -> DataFrame:
    """Features whose name points to the future or that almost equal the target."""
    # Name parts that point to the future.
    parts = ("future", "lead", "next", "tomorrow", "ahead")
    named = [c for c in features if any(p in c.lower() for p in parts) or "lag_-" in c.lower()]
    corr = pf.target_correlation(df, target, features, None)
    return corr.select(
        "feature", "correlation", flag(F.col("feature").isin(*named) if named else F.lit(False)).alias("suspicious_name"),
        flag(F.col("strength") > limit).alias("equals_target"),
    )


def leakage_by_time(df: DataFrame, target: str, features: Sequence[str], order: str, folds: int = 5, limit: float = 0.999, factor: float = 2.0) -> DataFrame:
    """Per feature what the audit says, and the error of chronological cross-validation with all
    features (mean and deviation over the folds) and without this one; it leaks if it is suspicious
    or if the error without it is ``factor`` times as large.

    Time is cut into folds + 1 stretches of equal rows (equal times stay together); each is
    predicted by a least-squares fit on all earlier ones. Fits and errors need only sums of products
    per stretch, so one pass serves every fold and every left-out feature. Rows with a missing
    value are left out. A fold without rows or with fewer rows than features is skipped.
    """
    cols = [*features, target]
    at = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    whole = df.select(order, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    for c in cols:
        whole = whole.where(~F.isnan(c))
    clean = whole.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)], at.alias("at"))
    edges = exact_quantiles(clean, ["at"], [k / (folds + 1) for k in range(1, folds + 1)])["at"]
    scale = clean.agg(*[F.struct(F.avg(f"x{i}").alias("m"), F.stddev_pop(f"x{i}").alias("s")).alias(f"x{i}") for i in range(len(cols))]).first()
    audit = {r["feature"]: r for r in leakage_audit(whole, target, features, limit).collect()}  # one row per feature
    schema = "feature string, suspicious_name int, equals_target int, cv_mse double, cv_mse_std double, mse_without double, leaks int"
    if edges[0] is None:
        return df.sparkSession.createDataFrame([], schema)
    stretch = F.lit(0)
    for e in edges:
        stretch = stretch + (F.col("at") > e).cast("int")
    size = len(cols) + 1
    z = [F.lit(1.0), *[(F.col(f"x{i}") - scale[f"x{i}"]["m"]) / (scale[f"x{i}"]["s"] or 1.0) for i in range(len(cols))]]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    staged = clean.select(stretch.alias("stretch"), *[v.alias(f"z{i}") for i, v in enumerate(z)])
    sums = staged.groupBy("stretch").agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    moments = np.zeros((folds + 1, size, size))
    for r in sums.collect():  # one row per stretch
        for i, j in pairs:
            moments[r["stretch"], i, j] = moments[r["stretch"], j, i] = r[f"s{i}_{j}"]
    unit = (scale[f"x{len(cols) - 1}"]["s"] or 1.0) ** 2

    def errors(kept: list[int]) -> list[float]:
        out = []
        for k in range(1, folds + 1):
            past, now = moments[:k].sum(axis=0), moments[k]
            if past[0, 0] <= len(kept) or not now[0, 0]:
                continue
            b = np.linalg.lstsq(past[np.ix_(kept, kept)], past[kept, -1], rcond=1e-10)[0]
            out.append(max((now[-1, -1] - 2 * b @ now[kept, -1] + b @ now[np.ix_(kept, kept)] @ b) / now[0, 0], 0.0) * unit)
        return out

    every = list(range(size - 1))
    full = errors(every)
    rows = []
    for i, c in enumerate(features, 1):
        rest = errors([k for k in every if k != i])
        with_all, without = (float(np.mean(e)) if e else None for e in (full, rest))
        named, equal = audit[c]["suspicious_name"], audit[c]["equals_target"]
        caught = named or equal or (without is not None and without > factor * with_all)
        rows.append((c, named, equal, with_all, float(np.std(full)) if full else None, without, int(caught)))
    return df.sparkSession.createDataFrame(rows, schema)


def constraint_violations(df: DataFrame, rules: dict[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """(rule, violations): rows for which a rule is false, and rows that repeat a key."""
    entries = [F.struct(F.lit(n).alias("rule"), F.count_if(~rule).alias("violations")) for n, rule in rules.items()]
    out = df.agg(F.array(*entries).alias("__m")).select(F.inline("__m"))
    if key:
        dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(dup.select(F.lit("unique_key").alias("rule"), "violations"))
    return out


def orphans(df: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys without a parent row."""
    return df.select(*on).distinct().join(parent.select(*on), list(on), "left_anti")


def validate_integration(df: DataFrame, keys: Sequence[str], required: Sequence[str], covered: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Per key: rows, nulls in required columns, coverage; and whether excluded columns are absent."""
    have = [c for c in excluded if c in df.columns]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in required],
        F.count(covered).alias("covered_rows"),
        F.lit(0 if have else 1).alias("excluded_absent"),
    )


def feature_opportunities(df: DataFrame) -> DataFrame:
    """Class of each column and the features that suit it."""
    s = type_scores(df)
    kind = (
        F.when(F.col("column").isin(*(datetime_columns(df) or [""])), "datetime")
        .when(F.col("column").isin(*(numeric_columns(df) or [""])), "numeric")
        .when(F.col("detected_type").isin("categorical", "boolean"), "categorical")
        .otherwise("text")
    )
    plan = (
        F.when(F.col("kind") == "datetime", "calendar, cyclical")
        .when(F.col("kind") == "numeric", "lags, rolling, scaling")
        .when(F.col("kind") == "categorical", "label encoding")
        .otherwise("text statistics")
    )
    return s.withColumn("kind", kind).select("column", "kind", "distinct", plan.alias("plan"))
