"""Scalar feature columns: calendar, cyclical, transforms, sentiment arithmetic, casts."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.num import sdiv


def calendar_features(c: Column) -> dict[str, Column]:
    day = F.to_date(c)
    quarter_start = F.trunc(day, "quarter")
    month = F.month(c)
    return {
        "year": F.year(c),
        "month": month,
        "day": F.dayofmonth(c),
        "dayofweek": F.weekday(c),
        "dayofyear": F.dayofyear(c),
        "week": F.weekofyear(c),
        "quarter": F.quarter(c),
        "hour": F.hour(c),
        "minute": F.minute(c),
        "second": F.second(c).cast("int"),
        "is_weekend": (F.weekday(c) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(c) == 1).cast("int"),
        "is_month_end": (day == F.last_day(day)).cast("int"),
        "is_quarter_start": (day == quarter_start).cast("int"),
        "is_quarter_end": (day == F.date_sub(F.add_months(quarter_start, 3), 1)).cast("int"),
        "is_year_start": (F.dayofyear(c) == 1).cast("int"),
        "is_year_end": ((month == 12) & (F.dayofmonth(c) == 31)).cast("int"),
    }


# Cycle lengths.
CYCLES = {"month": 12, "day": 30, "dayofweek": 7, "dayofyear": 365, "hour": 24}


def cyclical_features(c: Column) -> dict[str, Column]:
    parts = calendar_features(c)
    out = {}
    for name, period in CYCLES.items():
        angle = parts[name] * (2 * F.pi() / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


# Fixed values: (month, day) of holidays.
HOLIDAYS = ((1, 1), (7, 4), (12, 25))


def seasonal_features(c: Column) -> dict[str, Column]:
    code = F.month(c) * 100 + F.dayofmonth(c)
    return {
        "season": F.floor((F.month(c) % 12 + 3) / 3).cast("int"),
        "is_holiday": code.isin([m * 100 + d for m, d in HOLIDAYS]).cast("int"),
        "is_business_day": (F.weekday(c) < 5).cast("int"),
    }


def weighted_sentiment(news: Column, social: Column) -> Column:
    return F.coalesce(news, F.lit(0.0)) * 0.6 + F.coalesce(social, F.lit(0.0)) * 0.4


def volume_sentiment(df: DataFrame, axis, volume: str = "volume", sentiment: str = "combined_sentiment") -> DataFrame:
    """Volume times absolute sentiment, and that over (mean volume of the series + 1)."""
    from marketweave.operators.skew import join_key_values

    mean = df.groupBy(*axis.keys).agg((F.avg(volume) + 1).alias("__mean"), F.count(F.lit(1)).alias("__rows"))
    out = df.withColumn("volume_sentiment", F.col(volume) * F.abs(sentiment))
    both = out.join(mean, list(axis.keys)) if axis.bounded else join_key_values(out, mean, axis.keys, "__rows")
    return both.withColumn("volume_sentiment_ratio", sdiv("volume_sentiment", "__mean")).drop("__mean", "__rows")


def vote_balance(up: Column, down: Column) -> Column:
    return F.coalesce(sdiv(up - down, up + down), F.lit(0.0))


# Words of the boolean map.
TRUE_WORDS = ("true", "yes", "1", "t", "y")
FALSE_WORDS = ("false", "no", "0", "f", "n")


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Column) -> Column:
    """Number or null. A failed cast costs an exception, so the shape is tested first."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def inverse_yeo_johnson(x: Column, lam: float) -> Column:
    """Undo the power transform; each sign has its own branch and its own limit case."""
    pos = F.exp(x) - 1 if lam == 0 else F.pow(F.greatest(x * lam + 1, F.lit(0.0)), 1 / lam) - 1
    if lam == 2:
        neg = 1 - F.exp(-x)
    else:
        neg = 1 - F.pow(F.greatest(1 - (2 - lam) * x, F.lit(0.0)), 1 / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(F.greatest(x, F.lit(0.0))) if lam == 0 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, lam) - 1) / lam
    down = F.least(x, F.lit(0.0))
    neg = -F.log1p(-down) if lam == 2 else -(F.pow(1 - down, 2 - lam) - 1) / (2 - lam)
    return F.when(x >= 0, pos).when(x < 0, neg)


def interactions(cols: Sequence[str]) -> dict[str, Column]:
    """Products and ratios of every pair of the columns."""
    out = {}
    for a, b in itertools.combinations(cols, 2):
        out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        out[f"{a}_div_{b}"] = sdiv(a, b)
    return out
