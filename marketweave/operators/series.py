"""Technical and rolling features of ordered panels. Every operator takes a frame and an Axis."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.num import flag, sdiv
from marketweave.operators.axis import Axis, Frames, Stage, apply_stages, running
from marketweave.operators.skew import join_key_values

# Default periods.
SMA_PERIODS = (5, 10, 20, 50, 200)
EMA_PERIODS = (5, 10, 20, 50, 200)
LAGS = (1, 2, 3, 5, 7, 14, 21, 30)
ROLLING_WINDOWS = (3, 5, 7, 10, 14, 20, 30)
TRADING_DAYS = 252


def _full(n: int, agg, c):
    return lambda f: f.full(n, agg, c)


# -- moving averages --------------------------------------------------------------------------


def moving_averages(df: DataFrame, axis: Axis, price: str = "close", periods: Sequence[int] = SMA_PERIODS) -> DataFrame:
    return apply_stages(df, axis, [{f"sma_{n}": _full(n, F.avg, price) for n in periods}], back=max(periods) - 1)


def moving_averages_partial(df: DataFrame, axis: Axis, price: str = "close", periods: Sequence[int] = (20, 50, 200)) -> DataFrame:
    """Means over the rows seen so far (up to n) and the percentage distance to them."""
    means: Stage = {f"sma_{n}": (lambda f, n=n: f.over(F.avg, price, n)) for n in periods}
    dist: Stage = {f"price_vs_sma_{n}": (lambda f, n=n: (sdiv(price, f"sma_{n}") - 1) * 100) for n in periods}
    return apply_stages(df, axis, [means, dist], back=max(periods) - 1)


def average_spreads(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    out = moving_averages(df, axis, price, (20, 50, 200))
    return out.withColumns(
        {
            "sma_20_vs_50": F.col("sma_20") - F.col("sma_50"),
            "sma_50_vs_200": F.col("sma_50") - F.col("sma_200"),
            **{f"price_vs_sma_{n}": sdiv(price, f"sma_{n}") for n in (20, 50, 200)},
        }
    )


# -- exponential averages ---------------------------------------------------------------------


def _ema_stages(specs: dict[str, tuple[str, int]]) -> list[Stage]:
    """y = x at the first value, then (q^g y_prev + a x) / (q^g + a) with g the rows since the value
    before (1 without nulls, when the divisor is 1); rows without a value keep the last y.

    As running sums: q to the row number times the divisors so far takes the place of the product
    of all weights. The powers would overflow on long series, so rows are cut into segments and the
    last values of the earlier segments are carried over with their decayed weight, as far back as
    that weight still matters in double precision.
    """
    ratios = {name: (span - 1) / (span + 1) for name, (_, span) in specs.items()}
    smallest = min(x for x in ratios.values() if x > 0) if any(ratios.values()) else 0.5
    largest = max([*ratios.values(), 0.0])
    seg_len = max(int(500 / -math.log(smallest)), 1)
    carries = max(1, math.ceil(40 / (-math.log(largest) * seg_len))) if largest > 0 else 1
    pos = F.col("__pos").cast("double")
    moving = [n for n in specs if ratios[n] > 0]

    def segment(f: Frames):
        return Window.partitionBy(*f.keys, "__seg").orderBy(*f.order).rowsBetween(Window.unboundedPreceding, 0)

    def before(c: str):
        return lambda f: F.max(F.when(F.col(c).isNotNull(), F.col("__erow"))).over(f.w.rowsBetween(Window.unboundedPreceding, -1))

    def divisor(name: str):
        c, span = specs[name]
        gap = F.col("__erow") - F.col(f"__prev_{c}")
        log = F.ln(F.pow(F.lit(ratios[name]), gap.cast("double")) + 2 / (span + 1))
        return lambda f: F.when(F.col(c).isNotNull() & (gap > 1), log).otherwise(0.0)

    def local(name: str):
        c, span = specs[name]
        weight = F.when(F.col(f"__prev_{c}").isNull(), F.lit(1.0)).otherwise(2 / (span + 1) * F.exp(-F.col(f"__div_{name}")))
        term = F.col(c) * weight * F.pow(F.lit(ratios[name]), -pos) * F.exp(f"__divs_{name}")
        return lambda f: F.coalesce(F.sum(term).over(segment(f)), F.lit(0.0)) * F.pow(F.lit(ratios[name]), pos) * F.exp(-F.col(f"__divs_{name}"))

    def carry(name: str):
        ratio = ratios[name]

        def build(f: Frames) -> Column:
            total, passed = F.lit(0.0), F.lit(0.0)
            for k in range(1, carries + 1):
                w = Window.partitionBy(*f.keys).orderBy("__seg").rangeBetween(-k, -k)
                last = F.coalesce(F.max_by(f"__local_{name}", "__erow").over(w), F.lit(0.0))
                total = total + last * (ratio ** (seg_len * (k - 1))) * F.exp(-passed)
                passed = passed + F.coalesce(F.max_by(f"__divs_{name}", "__erow").over(w), F.lit(0.0))
            return F.col(f"__local_{name}") + F.pow(F.lit(ratio), pos + 1) * F.exp(-F.col(f"__divs_{name}")) * total

        return build

    def held(name: str):
        value = F.col(f"__full_{name}") if name in moving else F.col(specs[name][0]).cast("double")
        return lambda f: F.last(F.when(F.col(specs[name][0]).isNotNull(), value), ignorenulls=True).over(f.running())

    return [
        {"__erow": lambda f: (F.row_number().over(f.w) - 1).cast("long")},
        {
            "__seg": lambda f: F.floor(F.col("__erow") / seg_len).cast("long"),
            "__pos": lambda f: F.col("__erow") % seg_len,
            **{f"__prev_{c}": before(c) for c in dict.fromkeys(c for c, _ in specs.values())},
        },
        {f"__div_{n}": divisor(n) for n in moving},
        {f"__divs_{n}": (lambda f, n=n: F.sum(f"__div_{n}").over(segment(f))) for n in moving},
        {f"__local_{n}": local(n) for n in moving},
        {f"__full_{n}": carry(n) for n in moving},
        {n: held(n) for n in specs},
    ]


def _ema_drop(specs) -> list[str]:
    return ["__erow", "__seg", "__pos", *{f"__prev_{c}" for c, _ in specs.values()}, *[f"__{k}_{n}" for n in specs for k in ("div", "divs", "local", "full")]]


def _ema_back(spans: Sequence[int]) -> int:
    """Rows after which the weight of an earlier value is below double precision."""
    return 20 * (max(spans) + 1)


def exponential_averages(df: DataFrame, axis: Axis, price: str = "close", spans: Sequence[int] = EMA_PERIODS) -> DataFrame:
    specs = {f"ema_{n}": (price, n) for n in spans}
    return apply_stages(df, axis, _ema_stages(specs), back=_ema_back(spans), drop=_ema_drop(specs))


def macd(df: DataFrame, axis: Axis, price: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    pair = {"__fast": (price, fast), "__slow": (price, slow)}
    sig = {"macd_signal": ("macd", signal)}
    stages = [
        *_ema_stages(pair),
        {"macd": lambda f: F.col("__fast") - F.col("__slow")},
        *_ema_stages(sig),
        {
            "macd_histogram": lambda f: F.col("macd") - F.col("macd_signal"),
            "macd_cross_above": lambda f: flag(F.col("macd") > F.col("macd_signal")),
            "macd_cross_below": lambda f: flag(F.col("macd") < F.col("macd_signal")),
        },
    ]
    back = _ema_back((fast, slow)) + _ema_back((signal,))
    drop = {*_ema_drop(pair), *_ema_drop(sig), "__fast", "__slow"}
    return apply_stages(df, axis, stages, back=back, drop=sorted(drop))


# -- oscillators and bands --------------------------------------------------------------------


def _rsi_stages(price: str, period: int, out: str) -> list[Stage]:
    def change(f: Frames) -> Column:
        return F.coalesce(F.col(price) - f.lag(price), F.lit(0.0))

    gain, loss = F.col("__gain_mean"), F.col("__loss_mean")
    return [
        {"__gain": lambda f: F.greatest(change(f), F.lit(0.0)), "__loss": lambda f: F.greatest(-change(f), F.lit(0.0))},
        {"__gain_mean": _full(period, F.avg, "__gain"), "__loss_mean": _full(period, F.avg, "__loss")},
        {
            out: lambda f: F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(
                100 - sdiv(F.lit(100.0), 1 + sdiv(gain, loss))
            )
        },
    ]


_RSI_DROP = ("__gain", "__loss", "__gain_mean", "__loss_mean")


def rsi(df: DataFrame, axis: Axis, price: str = "close", period: int = 14) -> DataFrame:
    """Relative strength from simple rolling means; all gains give 100, a flat series gives null."""
    name = f"rsi_{period}"
    stages = _rsi_stages(price, period, name)
    stages.append(
        {"rsi_oversold": lambda f: flag(F.col(name) < 30), "rsi_overbought": lambda f: flag(F.col(name) > 70)}
    )
    return apply_stages(df, axis, stages, back=period, drop=_RSI_DROP)


def bollinger(df: DataFrame, axis: Axis, price: str = "close", period: int = 20, width: float = 2.0) -> DataFrame:
    up, lo, mid = F.col("bb_upper"), F.col("bb_lower"), F.col("bb_middle")
    stages: list[Stage] = [
        {"bb_middle": _full(period, F.avg, price), "__sd": _full(period, F.stddev_samp, price)},
        {"bb_upper": lambda f: mid + width * F.col("__sd"), "bb_lower": lambda f: mid - width * F.col("__sd")},
        {"bb_position": lambda f: sdiv(F.col(price) - lo, up - lo), "bb_width": lambda f: sdiv(up - lo, mid)},
    ]
    return apply_stages(df, axis, stages, back=period - 1, drop=("__sd",))


def stochastic(
    df: DataFrame, axis: Axis, high: str = "high", low: str = "low", close: str = "close", period: int = 14, smooth: int = 3
) -> DataFrame:
    stages: list[Stage] = [
        {"__hh": _full(period, F.max, high), "__ll": _full(period, F.min, low)},
        {"stoch_k": lambda f: sdiv(F.col(close) - F.col("__ll"), F.col("__hh") - F.col("__ll")) * 100},
        {"stoch_d": _full(smooth, F.avg, "stoch_k")},
    ]
    return apply_stages(df, axis, stages, back=period + smooth - 2, drop=("__hh", "__ll"))


# -- returns, volatility, volume, ranges ------------------------------------------------------


def _return(price: str, n: int = 1):
    return lambda f: sdiv(F.col(price), f.lag(price, n)) - 1


def returns(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    return apply_stages(
        df,
        axis,
        [
            {
                "daily_return": _return(price),
                "log_return": lambda f: F.ln(F.when(F.col(price) > 0, sdiv(F.col(price), f.lag(price)))),
            }
        ],
        back=1,
    )


def volatility(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    stages: list[Stage] = [
        {"daily_return": _return(price)},
        {f"volatility_{n}d": _full(n, F.stddev_samp, "daily_return") for n in (5, 20)},
    ]
    return apply_stages(df, axis, stages, back=20)


def volume_features(df: DataFrame, axis: Axis, volume: str = "volume", periods: Sequence[int] = (5, 20)) -> DataFrame:
    stages: list[Stage] = [
        {f"volume_sma_{n}": _full(n, F.avg, volume) for n in periods},
        {f"volume_ratio_{n}": (lambda f, n=n: sdiv(volume, f"volume_sma_{n}")) for n in periods},
    ]
    return apply_stages(df, axis, stages, back=max(periods) - 1)


def support_resistance(df: DataFrame, axis: Axis, price: str = "close", window: int = 20) -> DataFrame:
    stages: list[Stage] = [
        {"rolling_high": _full(window, F.max, price), "rolling_low": _full(window, F.min, price)},
        {
            "dist_from_resistance": lambda f: sdiv(F.col("rolling_high") - F.col(price), F.col(price)),
            "dist_from_support": lambda f: sdiv(F.col(price) - F.col("rolling_low"), F.col(price)),
        },
    ]
    return apply_stages(df, axis, stages, back=window - 1)


def momentum(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    stage: Stage = {f"roc_{n}": (lambda f, n=n: _return(price, n)(f) * 100) for n in (1, 5, 20)}
    stage.update({f"momentum_{n}": _return(price, n) for n in (5, 20)})
    return apply_stages(df, axis, [stage], back=20)


def annual_volatility(df: DataFrame, axis: Axis, price: str = "close", periods: Sequence[int] = (20, 50)) -> DataFrame:
    scale = math.sqrt(TRADING_DAYS) * 100
    stages: list[Stage] = [
        {"__ret": _return(price)},
        {f"volatility_{n}": (lambda f, n=n: f.full(n, F.stddev_samp, "__ret") * scale) for n in periods},
    ]
    return apply_stages(df, axis, stages, back=max(periods), drop=("__ret",))


def true_range(
    df: DataFrame, axis: Axis, high: str = "high", low: str = "low", close: str = "close", period: int = 14
) -> DataFrame:
    """Mean true range; the first row of a series has only its own high-low range."""

    def span(f: Frames) -> Column:
        before = f.lag(close)
        return F.greatest(
            F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)
        )

    stages: list[Stage] = [{"true_range": span}, {f"atr_{period}": _full(period, F.avg, "true_range")}]
    return apply_stages(df, axis, stages, back=period)


def close_range(df: DataFrame, axis: Axis, price: str = "close", period: int = 14, default: float = 0.1) -> DataFrame:
    """Mean absolute change of the close; ``default`` while there are fewer than period + 1 rows."""
    stages: list[Stage] = [
        {"__move": lambda f: F.abs(F.col(price) - f.lag(price))},
        {"close_atr": lambda f: F.coalesce(f.full(period, F.avg, "__move"), F.lit(default))},
    ]
    return apply_stages(df, axis, stages, back=period, drop=("__move",))


# -- lags and rolling statistics --------------------------------------------------------------


def lag_features(
    df: DataFrame,
    axis: Axis,
    cols: Sequence[str],
    lags: Sequence[int] = LAGS,
    diffs: Sequence[int] = (1, 2, 3),
    changes: Sequence[int] = (1, 2, 3, 5),
    momentums: Sequence[int] = (),
) -> DataFrame:
    stage: Stage = {}
    for c in cols:
        stage.update({f"{c}_lag_{n}": (lambda f, c=c, n=n: f.lag(c, n)) for n in lags})
        stage.update({f"{c}_diff_{n}": (lambda f, c=c, n=n: F.col(c) - f.lag(c, n)) for n in diffs})
        stage.update({f"{c}_pct_change_{n}": _return(c, n) for n in changes})
        stage.update({f"{c}_momentum_{n}": (lambda f, c=c, n=n: F.col(c) - f.lag(c, n)) for n in momentums})
    return apply_stages(df, axis, [stage], back=max([*lags, *diffs, *changes, *momentums]))


def rolling_features(
    df: DataFrame,
    axis: Axis,
    cols: Sequence[str],
    windows: Sequence[int] = ROLLING_WINDOWS,
    stats: Sequence[str] = ("mean", "std", "min", "max", "median", "q25", "q75"),
    relative: bool = True,
) -> DataFrame:
    """Rolling statistics, each null until its frame is full, and the position of the row in them.

    A sliding frame is gone through again for every row and aggregate. Whether it is full is therefore
    told by running counts, and a sorted frame, where there is one, also gives its ends.
    """
    aggs = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    shares = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    seen: Stage = {f"__{c}_seen": (lambda f, c=c: F.count(c).over(f.running())) for c in cols}
    first: Stage = {}
    second: Stage = {}
    third: Stage = {}
    drop = list(seen)

    def at_share(arr: str, n: int, q: float):
        """Linear interpolation in a sorted frame of exactly n values."""
        pos = q * (n - 1)
        lo, frac = int(pos), pos - int(pos)
        a = F.col(arr)[lo]
        value = a if frac == 0 else a + (F.col(arr)[lo + 1] - a) * frac
        return F.when(F.size(arr) == n, value)

    for c in cols:
        for n in windows:
            before, arr = f"__{c}_seen_{n}", f"__{c}_frame_{n}"
            first[before] = lambda f, c=c, n=n: F.lag(f"__{c}_seen", n, 0).over(f.w)
            full = F.col(f"__{c}_seen") - F.col(before) == n
            ordered = any(st in shares for st in stats)
            drop.append(before)
            if ordered:
                # one sorted frame serves all its quantiles
                first[arr] = lambda f, c=c, n=n: F.sort_array(F.collect_list(c).over(f.rows(n)))
                drop.append(arr)
            for st in stats:
                name = f"{c}_rolling_{st}_{n}"
                if st in shares:
                    second[name] = lambda f, arr=arr, n=n, q=shares[st]: at_share(arr, n, q)
                elif ordered and st in ("min", "max"):
                    second[name] = lambda f, arr=arr, full=full, at=0 if st == "min" else n - 1: F.when(full, F.col(arr)[at])
                else:
                    first[f"__{name}"] = lambda f, c=c, n=n, st=st: f.over(aggs[st], c, n)
                    second[name] = lambda f, name=name, full=full: F.when(full, F.col(f"__{name}"))
                    drop.append(f"__{name}")
            if relative:
                mean, std = f"{c}_rolling_mean_{n}", f"{c}_rolling_std_{n}"
                third[f"{c}_vs_rolling_mean_{n}"] = lambda f, c=c, m=mean: sdiv(c, m) - 1
                third[f"{c}_zscore_{n}"] = lambda f, c=c, m=mean, s=std: sdiv(F.col(c) - F.col(m), F.col(s))
    return apply_stages(df, axis, [seen, first, second, third], back=max(windows) - 1, drop=drop)


# -- sentiment panels -------------------------------------------------------------------------


def sentiment_momentum(df: DataFrame, axis: Axis, c: str = "combined_sentiment") -> DataFrame:
    stage: Stage = {
        f"{c}_3d_ma": lambda f: f.over(F.avg, c, 3),
        f"{c}_7d_ma": lambda f: f.over(F.avg, c, 7),
        f"{c}_change": lambda f: F.coalesce(_return(c)(f), F.lit(0.0)),
    }
    return apply_stages(df, axis, [stage], back=6)


def activity_spikes(df: DataFrame, axis: Axis, c: str) -> DataFrame:
    """1 where the value is above 1.5 times its 7-row mean, and the value over (series maximum + 1)."""
    out = apply_stages(df, axis, [{f"{c}_spike": lambda f: flag(F.col(c) > 1.5 * f.full(7, F.avg, c))}], back=6)
    peak = df.groupBy(*axis.keys).agg((F.max(c) + 1).alias("__peak"), F.count(F.lit(1)).alias("__rows"))
    both = out.join(peak, list(axis.keys)) if axis.bounded else join_key_values(out, peak, axis.keys, "__rows")
    return both.withColumn(f"{c}_normalized", sdiv(c, "__peak")).drop("__peak", "__rows")


def price_sentiment_divergence(
    df: DataFrame, axis: Axis, price: str = "close", sentiment: str = "combined_sentiment", band: float = 0.02
) -> DataFrame:
    gap = F.col("price_sentiment_divergence")
    stages: list[Stage] = [
        {
            "price_sentiment_divergence": lambda f: F.coalesce(_return(price)(f), F.lit(0.0))
            - F.coalesce(F.col(sentiment) - f.lag(sentiment), F.lit(0.0))
        },
        {"divergence_signal": lambda f: F.when(gap > band, 1).when(gap < -band, -1).otherwise(0)},
    ]
    return apply_stages(df, axis, stages, back=1)


def composite_score(df: DataFrame, axis: Axis, price: str = "close", sentiment: str = "combined_sentiment") -> DataFrame:
    stages: list[Stage] = [
        {"__ret": _return(price)},
        {"composite_score": lambda f: (F.col(sentiment) + F.coalesce(f.full(5, F.avg, "__ret"), F.lit(0.0))) / 2},
    ]
    return apply_stages(df, axis, stages, back=5, drop=("__ret",))


# -- cumulative -------------------------------------------------------------------------------


def drawdown(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    out = running(df, axis, {"running_max": ("max", F.col(price))})
    return out.withColumn("drawdown", sdiv(price, "running_max") - 1)


def cumulative_return(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    """Product of (1 + return) minus 1, as running sums of logarithms, zeros and signs."""
    out = apply_stages(df, axis, [{"daily_return": _return(price)}], back=1)
    factor = 1 + F.col("daily_return")
    sums = {"__log": F.ln(F.when(factor != 0, F.abs(factor))), "__zeros": (factor == 0).cast("long"), "__minus": (factor < 0).cast("long")}
    out = running(out, axis, {name: ("sum", c) for name, c in sums.items()})
    sign = F.when(F.coalesce("__minus", F.lit(0)) % 2 == 1, -1.0).otherwise(1.0)
    product = F.when(F.col("__zeros") > 0, 0.0).otherwise(sign * F.exp(F.coalesce("__log", F.lit(0.0))))
    return out.withColumn("cumulative_return", product - 1).drop(*sums)


def fill_forward_backward(df: DataFrame, axis: Axis, cols: Sequence[str]) -> DataFrame:
    ahead = running(df, axis, {f"__f_{c}": ("last", F.col(c)) for c in cols})
    both = running(ahead, axis, {f"__b_{c}": ("last", F.col(c)) for c in cols}, reverse=True)
    filled = both.withColumns({c: F.coalesce(c, f"__f_{c}", f"__b_{c}") for c in cols})
    return filled.select(*df.columns)


def return_autocorrelation(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    pairs = apply_stages(
        apply_stages(df, axis, [{"__r": _return(price)}], back=1), axis, [{"__p": lambda f: f.lag("__r")}], back=1
    )
    both = F.col("__r").isNotNull() & F.col("__p").isNotNull()
    return pairs.groupBy(*axis.keys).agg(
        F.corr(F.when(both, F.col("__r")), F.when(both, F.col("__p"))).alias("autocorr_1"),
        F.count_if(both).alias("pairs"),
    )


# -- regimes ----------------------------------------------------------------------------------


def regime_vector(df: DataFrame, axis: Axis, price: str = "close") -> DataFrame:
    stages: list[Stage] = [
        {"daily_return": _return(price), "momentum_20": _return(price, 20)},
        {"volatility_20d": _full(20, F.stddev_samp, "daily_return")},
    ]
    return apply_stages(df, axis, stages, back=20)


def volatility_surface(df: DataFrame, axis: Axis, price: str = "close", horizons: Sequence[int] = (5, 10, 20, 50, 100)) -> DataFrame:
    """Long form: one row per bar and horizon."""
    scale = math.sqrt(TRADING_DAYS)
    stages: list[Stage] = [
        {"__ret": _return(price)},
        {f"__vol_{n}": (lambda f, n=n: f.full(n, F.stddev_samp, "__ret") * scale) for n in horizons},
    ]
    wide = apply_stages(df, axis, stages, back=max(horizons))
    pairs = ", ".join(f"{n}, __vol_{n}" for n in horizons)
    return wide.select(*axis.keys, *axis.order, F.expr(f"stack({len(horizons)}, {pairs}) as (horizon, volatility)"))


def regime_flag(df: DataFrame, axis: Axis, price: str = "close", fast: int = 20, slow: int = 50) -> DataFrame:
    stages: list[Stage] = [
        {"ma_fast": _full(fast, F.avg, price), "ma_slow": _full(slow, F.avg, price)},
        {"bull_regime": lambda f: (F.col("ma_fast") > F.col("ma_slow")).cast("int")},
    ]
    return apply_stages(df, axis, stages, back=slow - 1)


def market_regime(df: DataFrame, axis: Axis, price: str = "close", volume: str = "volume") -> DataFrame:
    """One label per series, from its last row and its volatility as a whole."""
    stages: list[Stage] = [
        {"__ret": _return(price)},
        {
            "__sd50": _full(50, F.stddev_samp, "__ret"),
            "__trend": lambda f: f.full(20, F.avg, price) - f.full(50, F.avg, price),
            "__vtrend": lambda f: f.full(20, F.avg, volume) > f.full(50, F.avg, volume),
        },
    ]
    rows = apply_stages(df, axis, stages, back=50)
    at = F.struct(*axis.order)
    per_key = rows.groupBy(*axis.keys).agg(
        F.count(price).alias("bars"),
        F.stddev_samp("__ret").alias("volatility"),
        F.avg("__sd50").alias("__avg_sd"),
        F.max_by("__trend", at).alias("__last_trend"),
        F.max_by("__vtrend", at).alias("__last_vtrend"),
    )
    base = F.coalesce("__avg_sd", "volatility")
    trend = F.coalesce("__last_trend", F.lit(0.0))
    rising = F.coalesce("__last_vtrend", F.lit(True))
    label = (
        F.when(F.col("bars") <= 20, "NEUTRAL")
        .when(F.col("volatility") > 1.5 * base, "HIGH_VOLATILITY")
        .when((trend > 0) & rising, "BULLISH")
        .when((trend < 0) & rising, "BEARISH")
        .otherwise("NEUTRAL")
    )
    return per_key.select(*axis.keys, "bars", "volatility", trend.alias("trend"), label.alias("regime"))


def latest_snapshot(df: DataFrame, axis: Axis, price: str = "close", volume: str = "volume") -> DataFrame:
    """The indicators of the last row of each series, with fallbacks for short series."""
    specs = {"ema_12": (price, 12), "ema_26": (price, 26)}
    signal = {"macd_signal": ("macd", 9)}
    stages: list[Stage] = [
        *_ema_stages(specs),
        {"macd": lambda f: F.col("ema_12") - F.col("ema_26")},
        *_ema_stages(signal),
        *_rsi_stages(price, 14, "rsi"),
        {"__ret": _return(price), "__move": lambda f: F.abs(F.col(price) - f.lag(price))},
        {
            "sma_20": _full(20, F.avg, price),
            "sma_50": _full(50, F.avg, price),
            "__sd20": _full(20, F.stddev_samp, price),
            "volume_sma": _full(20, F.avg, volume),
            "volatility_20d": _full(20, F.stddev_samp, "__ret"),
            "atr": _full(14, F.avg, "__move"),
        },
    ]
    rows = apply_stages(df, axis, stages, back=_ema_back((26,)) + _ema_back((9,)) + 51)
    names = ["sma_20", "sma_50", "ema_12", "ema_26", "macd", "macd_signal", "rsi", "__sd20", "volume_sma", "volatility_20d", "atr"]
    at = F.struct(*axis.order)
    last = rows.groupBy(*axis.keys).agg(
        F.max_by(F.struct(price, volume, *names), at).alias("__s"),
        F.avg(price).alias("__mean_price"),
        F.max(price).alias("__max_price"),
        F.min(price).alias("__min_price"),
        F.avg(volume).alias("__mean_volume"),
    )
    s = {n: F.col(f"__s.{n}") for n in [price, volume, *names]}
    out = last.select(
        *axis.keys,
        s[price].alias("price"),
        F.coalesce(s["sma_20"], F.col("__mean_price")).alias("sma_20"),
        F.coalesce(s["sma_50"], F.col("__mean_price")).alias("sma_50"),
        s["ema_12"].alias("ema_12"),
        s["ema_26"].alias("ema_26"),
        s["macd"].alias("macd"),
        s["macd_signal"].alias("macd_signal"),
        (s["macd"] - s["macd_signal"]).alias("macd_histogram"),
        F.coalesce(s["rsi"], F.lit(50.0)).alias("rsi"),
        F.coalesce(s["sma_20"] + 2 * s["__sd20"], F.col("__max_price")).alias("bb_upper"),
        F.coalesce(s["sma_20"] - 2 * s["__sd20"], F.col("__min_price")).alias("bb_lower"),
        F.coalesce(sdiv(s[price] - (s["sma_20"] - 2 * s["__sd20"]), 4 * s["__sd20"]), F.lit(0.5)).alias("bb_position"),
        F.coalesce(s["volume_sma"], F.col("__mean_volume")).alias("volume_sma"),
        F.coalesce(s["volatility_20d"], F.lit(0.1)).alias("volatility_20d"),
        F.coalesce(s["atr"], F.lit(0.1)).alias("atr"),
        s[volume].alias("__vol"),
    )
    return out.withColumn(
        "volume_ratio", F.when(F.col("volume_sma") > 0, sdiv("__vol", "volume_sma")).otherwise(F.lit(1.0))
    ).drop("__vol")


def regular_frequency(df: DataFrame, axis: Axis, unit_seconds: int = 1, threshold: float = 0.8) -> DataFrame:
    """Share of the most common gap between neighbouring rows; regular above the threshold."""
    seconds = F.unix_timestamp(F.col(axis.order[0]).cast("timestamp"))
    gaps = apply_stages(
        df.withColumn("__s", F.floor(seconds / unit_seconds).cast("long")),
        axis,
        [{"__gap": lambda f: F.col("__s") - f.lag("__s")}],
        back=1,
    ).filter(F.col("__gap").isNotNull())
    counts = gaps.groupBy(*axis.keys, "__gap").agg(F.count(F.lit(1)).alias("__n"))
    per_key = counts.groupBy(*axis.keys).agg(
        F.max_by("__gap", F.struct(F.col("__n"), -F.col("__gap"))).alias("modal_gap"),
        F.max("__n").alias("__top"),
        F.sum("__n").alias("gaps"),
    )
    return per_key.select(
        *axis.keys, "modal_gap", "gaps", sdiv("__top", "gaps").alias("modal_share"),
        flag(sdiv("__top", "gaps") > threshold).alias("is_regular"),
    )
