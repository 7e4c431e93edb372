"""Small numeric column helpers that keep ANSI mode from raising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sdiv(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def flag(cond: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def clip(c: Column, lo=None, hi=None) -> Column:
    """Limit to [lo, hi] and keep nulls null."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(c.isNotNull(), out)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def nan_to_null(c) -> Column:
    """As double, NaN as null; infinities stay."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(d), d)


def inf_to(c: Column, value) -> Column:
    return F.when(F.abs(c) == float("inf"), F.lit(value)).otherwise(c)


def r(c, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, keep: Sequence[str], digits: dict[str, int]) -> DataFrame:
    """The columns ``keep`` and the rounded ones. Many columns are rounded inside one array per number
    of digits: rounded one by one, their code is one method too large for the JVM to compile."""
    groups = {n: [c for c, m in digits.items() if m == n] for n in dict.fromkeys(digits.values())}
    to = lambda n: lambda x: F.round(x, n)
    arrays = [F.transform(F.array(*[F.col(c).cast("double") for c in cols]), to(n)).alias(f"__r{n}") for n, cols in groups.items()]
    return df.select(*keep, *arrays).select(*keep, *[F.col(f"__r{n}")[groups[n].index(c)].alias(c) for c, n in digits.items()])


def numeric_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population value."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population value."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def bound(value: Column, use) -> Column:
    """``use`` over a column that it mentions several times: the value stands once in the plan, as the
    only element of an array, instead of once per mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
