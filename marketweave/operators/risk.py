"""Risk figures of price series, spectra, breaks, alerts and drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.num import sample_kurtosis, sample_skew, sdiv
from marketweave.operators.axis import Axis, Stage, apply_stages, number_rows, running


def risk_panel(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    """Annual volatility, Sharpe, maximum drawdown, VaR and CVaR at 95 %, skew, kurtosis, lag-1
    autocorrelation per series. The series must be bounded (bars), for the exact quantile."""
    rows = apply_stages(df, axis, [{"__r": lambda f: sdiv(F.col(price), f.lag(price)) - 1}, {"__p": lambda f: f.lag("__r")}], back=2)
    rows = running(rows, axis, {"__peak": ("max", F.col(price))})
    part = Window.partitionBy(*axis.keys)
    rows = rows.withColumn("__var", F.percentile("__r", 0.05).over(part))
    n = F.count("__r")
    return rows.groupBy(*axis.keys).agg(
        (F.stddev_samp("__r") * math.sqrt(252)).alias("annual_volatility"),
        F.coalesce(sdiv(F.avg("__r"), F.stddev_samp("__r")) * math.sqrt(252), F.lit(0.0)).alias("sharpe_ratio"),
        F.min(sdiv(price, "__peak") - 1).alias("max_drawdown"),
        F.first("__var").alias("var_95"),
        F.avg(F.when(F.col("__r") <= F.col("__var"), F.col("__r"))).alias("cvar_95"),
        sample_skew(F.skewness("__r"), n).alias("skewness"),
        sample_kurtosis(F.kurtosis("__r"), n).alias("kurtosis"),
        F.corr(F.when(F.col("__p").isNotNull(), F.col("__r")), F.col("__p")).alias("autocorr_1"),
    )


def risk_return(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    rows = apply_stages(df, axis, [{"__r": lambda f: sdiv(F.col(price), f.lag(price)) - 1}], back=1)
    return rows.groupBy(*axis.keys).agg(
        (F.avg("__r") * 252).alias("annual_return"), (F.stddev_samp("__r") * math.sqrt(252)).alias("annual_volatility")
    )


def equity_risk(path: DataFrame, axis: Axis, value: str = "portfolio_value") -> DataFrame:
    rows = apply_stages(path, axis, [{"__r": lambda f: sdiv(F.col(value), f.lag(value)) - 1}], back=1)
    rows = running(rows, axis, {"__peak": ("max", F.col(value))})
    at = F.struct(*axis.order)
    return rows.groupBy(*axis.keys).agg(
        (sdiv(F.max_by(value, at), F.min_by(value, at)) - 1).alias("total_return"),
        (F.stddev_pop("__r") * math.sqrt(252)).alias("volatility"),
        F.coalesce(sdiv(F.avg("__r"), F.stddev_pop("__r")) * math.sqrt(252), F.lit(0.0)).alias("sharpe_ratio"),
        F.min(sdiv(value, "__peak") - 1).alias("max_drawdown"),
    )


def hurst(df: DataFrame, axis: Axis, price: str = "close", max_lag: int = 50) -> DataFrame:
    """Slope of log deviation of lagged differences of returns against log lag."""
    lags = range(2, max_lag)
    stages: list[Stage] = [
        {"__r": lambda f: sdiv(F.col(price), f.lag(price)) - 1},
        {f"__d{k}": (lambda f, k=k: f.lead("__r", k) - F.col("__r")) for k in lags},
    ]
    rows = apply_stages(df, axis, stages, back=1, ahead=max_lag)
    taus = rows.groupBy(*axis.keys).agg(*[F.stddev_pop(f"__d{k}").alias(f"__t{k}") for k in lags])
    pairs = ", ".join(f"{math.log(k)!r}D, __t{k}" for k in lags)
    long = taus.select(*axis.keys, F.expr(f"stack({len(lags)}, {pairs}) as (x, tau)")).filter(F.col("tau") > 0)
    return long.groupBy(*axis.keys).agg(F.regr_slope(F.ln("tau"), F.col("x")).alias("hurst"))


def spectrum(df: DataFrame, axis: Axis, value: str = "close", top: int = 3) -> DataFrame:
    """Strongest periods of each bounded series: power of the centred values per whole frequency,
    from one sum of cosines and one of sines per frequency. The sums combine before the shuffle, so
    no task holds a series; the work grows with the square of the length of a series."""
    if not axis.bounded:
        raise ValueError("spectrum: the work per series grows with the square of its length; bound the axis")
    keys = list(axis.keys)
    part = Window.partitionBy(*keys)
    rows = number_rows(df.select(*keys, *axis.order, F.col(value).cast("double").alias("__x")), axis, "__t", size="__n")
    rows = rows.withColumn("__x", F.col("__x") - F.avg("__x").over(part)).where("__n > 2")
    waves = rows.withColumn("__f", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("__n") + 1) / 2) - 1)))
    # the angle from the remainder keeps the argument small and exact
    angle = 2 * math.pi * ((F.col("__f") * F.col("__t")) % F.col("__n")) / F.col("__n")
    sums = waves.groupBy(*keys, "__n", "__f").agg(F.sum(F.col("__x") * F.cos(angle)).alias("__c"), F.sum(F.col("__x") * F.sin(angle)).alias("__s"))
    power = F.col("__c") * F.col("__c") + F.col("__s") * F.col("__s")
    ranked = sums.withColumn("power", power).withColumn("rank", F.row_number().over(part.orderBy(F.desc("power"), "__f")))
    return ranked.where(F.col("rank") <= top).select(*keys, "rank", (F.col("__n") / F.col("__f")).alias("period"), "power")


def structural_breaks(df: DataFrame, axis: Axis, value: str = "close", breaks: int = 5, shortest: int = 2) -> DataFrame:
    """Best mean shifts by binary segmentation, all series at once and for bounded series.

    Each round scores every cut of every segment from prefix sums and takes the best one of the
    series. All windows share the partitioning by key, so the rounds add sorts but no shuffles.
    """
    keys, order = list(axis.keys), list(axis.order)
    part, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, F.col(value).cast("double").alias("__x")).withColumns({"__rn": F.row_number().over(w), "__seg": F.lit(0)})
    x = F.col("__x")
    for k in range(1, breaks + 1):
        seg = Window.partitionBy(*keys, "__seg")
        upto = seg.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns(
            {"__n": F.count(x).over(upto).cast("double"), "__s": F.sum(x).over(upto), "__nt": F.count(x).over(seg).cast("double"), "__st": F.sum(x).over(seg)}
        )
        n, s, all_n, all_s = (F.col(c) for c in ("__n", "__s", "__nt", "__st"))
        gain = s * s / n + (all_s - s) * (all_s - s) / (all_n - n) - all_s * all_s / all_n
        gain = F.when((n >= shortest) & (all_n - n >= shortest), gain)
        rows = rows.withColumn("__g", gain)
        best = F.max(F.when(F.col("__g").isNotNull(), F.struct("__g", (-F.col("__rn")).alias("r"), F.col("__seg").alias("q")))).over(part)
        rows = rows.withColumn("__best", best)
        after = (F.col("__seg") == F.col("__best.q")) & (F.col("__rn") > -F.col("__best.r"))
        rows = rows.withColumns(
            {f"__gain{k}": F.col("__best.__g"), "__seg": F.when(after, F.lit(k)).otherwise(F.col("__seg"))}
        )
    starts = rows.groupBy(*keys, "__seg").agg(
        F.min(F.struct(*order)).alias("__o"), F.count(F.lit(1)).alias("rows"), F.avg("__x").alias("mean"),
        *[F.first(f"__gain{k}").alias(f"__gain{k}") for k in range(1, breaks + 1)],
    )
    gain = F.lit(None).cast("double")
    for k in range(1, breaks + 1):
        gain = F.when(F.col("__seg") == k, F.col(f"__gain{k}")).otherwise(gain)
    return starts.select(*keys, F.col("__seg").alias("segment"), *[F.col(f"__o.{o}").alias(o) for o in order], "rows", "mean", gain.alias("gain"))


# -- alerts and drift -------------------------------------------------------------------------


def equity_alerts(path: DataFrame, axis: Axis, capital: float, value: str = "portfolio_value", max_drawdown: float = 0.15, daily_loss: float = 0.02) -> DataFrame:
    """One row per alert: drawdown beyond the limit, daily loss beyond 2 % of the start capital,
    total return below -5 %, less than 30 % of the days so far with a gain, value at or below zero."""
    rows = apply_stages(path, axis, [{"__prev": lambda f: f.lag(value)}], back=1)
    gain = (F.col(value) > F.col("__prev")).cast("long")
    rows = running(rows, axis, {"__top": ("max", F.col(value)), "__gains": ("sum", gain), "__days": ("sum", F.col("__prev").isNotNull().cast("long"))})
    peak = F.greatest(F.col("__top"), F.lit(capital))
    v = F.col(value)
    kinds = F.array_compact(
        F.array(
            F.when(v <= 0, F.lit("portfolio_zero")),
            F.when((v > 0) & (sdiv(peak - v, peak) > max_drawdown), F.lit("max_drawdown")),
            F.when(v - F.col("__prev") < -capital * daily_loss, F.lit("daily_loss")),
            F.when(v / capital - 1 < -0.05, F.lit("portfolio_down")),
            F.when(sdiv("__gains", "__days") < 0.3, F.lit("low_win_rate")),
        )
    )
    return rows.select(*axis.keys, *axis.order, value, F.explode(kinds).alias("alert"))


def drift_flags(rows: np.ndarray, recent: np.ndarray, history: np.ndarray, last: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The two flags of ``model_drift`` over arrays; unknown means are NaN and raise no flag."""
    return (recent > factor * history).astype(int), ((rows > 10) & (last > 0.1)).astype(int)


def model_drift(errors: DataFrame, axis: Axis, error: str, window: int = 100, factor: float = 1.5) -> DataFrame:
    """Mean error of the last rows of each model against the rows before them."""
    rows = number_rows(errors, axis, "__rn", size="__n")
    recent = F.col("__rn") >= F.col("__n") - window
    out = rows.groupBy(*axis.keys).agg(
        F.first("__n").alias("rows"), F.avg(F.when(recent, F.col(error))).alias("recent_error"), F.avg(F.when(~recent, F.col(error))).alias("historical_error"),
        F.avg(F.when(F.col("__rn") >= F.col("__n") - 10, F.col(error))).alias("last_10_error"),
    )
    return out.withColumns(
        {
            "drift": F.coalesce((F.col("recent_error") > factor * F.col("historical_error")).cast("int"), F.lit(0)),
            "high_error": F.when(F.col("rows") > 10, (F.col("last_10_error") > 0.1).cast("int")).otherwise(0),
        }
    )
