"""Queries over bars and ticks: indicators, lags, rolling statistics, cumulative features, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions.num import r, rounded
from marketweave.operators import labels as lab
from marketweave.operators import series as s
from marketweave.plans.registry import query
from marketweave.plans.roles import BAR_AXIS, SQL_BARS, SQL_NEWS, TICK_AXIS, bars, daily_orders, sql_full, ticks

WITH = "WITH " + SQL_BARS
W = "(PARTITION BY key ORDER BY day)"
RET = f"close / nullif(lag(close) OVER {W}, 0) - 1"
FULL = sql_full


def _pick(df, *cols, digits=4, keep=()):
    return df.select("key", "day", *keep, *[r(c, digits).alias(c) for c in cols])


def _sql_pick(src: str, cols: list[str], digits=4, keep=()) -> str:
    return f"SELECT key, day, {''.join(k + ', ' for k in keep)}{', '.join(f'round({c}, {digits}) AS {c}' for c in cols)} FROM {src}"


_SMA = [f"sma_{n}" for n in (5, 10, 20, 50, 200)]


@query(
    "simple_moving_averages",
    f"{WITH}, x AS (SELECT *, {', '.join(f'{FULL(n, chr(97) + chr(118) + chr(103), chr(99) + chr(108) + chr(111) + chr(115) + chr(101))} AS sma_{n}' for n in (5, 10, 20, 50, 200))} FROM bars) "
    + _sql_pick("x", _SMA, 5),
)
def simple_moving_averages(spark, sf):
    return _pick(s.moving_averages(bars(spark, sf), BAR_AXIS), *_SMA, digits=5)


@query(
    "partial_moving_averages",
    f"""{WITH}, x AS (SELECT *, {', '.join(f'avg(volume) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sma_{n}' for n in (20, 50, 200))} FROM bars)
    SELECT key, day, {', '.join(f'round(sma_{n}, 7) AS sma_{n}, round((volume / sma_{n} - 1) * 100, 7) AS price_vs_sma_{n}' for n in (20, 50, 200))} FROM x""",
)
def partial_moving_averages(spark, sf):
    out = s.moving_averages_partial(bars(spark, sf), BAR_AXIS, "volume")
    return _pick(out, *[c for n in (20, 50, 200) for c in (f"sma_{n}", f"price_vs_sma_{n}")], digits=7)


@query(
    "moving_average_spreads",
    f"""{WITH}, x AS (SELECT *, {FULL(20, 'avg', 'close')} AS a, {FULL(50, 'avg', 'close')} AS b, {FULL(200, 'avg', 'close')} AS c FROM bars)
    SELECT key, day, round(a - b, 4) AS sma_20_vs_50, round(b - c, 5) AS sma_50_vs_200,
           round(close / a, 6) AS price_vs_sma_20, round(close / b, 6) AS price_vs_sma_50, round(close / c, 6) AS price_vs_sma_200 FROM x""",
)
def moving_average_spreads(spark, sf):
    out = s.average_spreads(bars(spark, sf), BAR_AXIS)
    return out.select(
        "key", "day", r("sma_20_vs_50", 4).alias("sma_20_vs_50"), r("sma_50_vs_200", 5).alias("sma_50_vs_200"),
        *[r(f"price_vs_sma_{n}", 6).alias(f"price_vs_sma_{n}") for n in (20, 50, 200)],
    )


def _sql_ema(cols: dict[str, int], src: str = "bars", value: str = "close") -> str:
    first = ", ".join(f"v AS {c}" for c in cols)
    step = ", ".join(f"p.{c} * {(n - 1) / (n + 1)!r} + n.v * {2 / (n + 1)!r}" for c, n in cols.items())
    return f"""RECURSIVE {{bars}}, num AS MATERIALIZED (SELECT key, day, {value} AS v, row_number() OVER {W} AS rn FROM {src}),
    ema AS (SELECT key, day, rn, v, {first} FROM num WHERE rn = 1
            UNION ALL SELECT n.key, n.day, n.rn, n.v, {step} FROM ema p JOIN num n ON n.key = p.key AND n.rn = p.rn + 1)"""


@query(
    "exponential_moving_averages",
    "WITH " + _sql_ema({f"ema_{n}": n for n in s.EMA_PERIODS}).format(bars=SQL_BARS)
    + " " + _sql_pick("ema", [f"ema_{n}" for n in s.EMA_PERIODS]),
)
def exponential_moving_averages(spark, sf):
    return _pick(s.exponential_averages(bars(spark, sf), BAR_AXIS), *[f"ema_{n}" for n in s.EMA_PERIODS])


@query(
    "exponential_mean_over_gaps",
    f"""WITH RECURSIVE {SQL_BARS}, num AS MATERIALIZED (SELECT key, day, CASE WHEN day(day) % 4 <> 0 THEN close END AS v, row_number() OVER {W} AS rn FROM bars),
    e AS (SELECT key, day, rn, v AS y, CAST(1 AS BIGINT) AS g FROM num WHERE rn = 1 UNION ALL
      SELECT n.key, n.day, n.rn, CASE WHEN n.v IS NULL THEN p.y WHEN p.y IS NULL THEN n.v ELSE (pow({11 / 13!r}, p.g) * p.y + {2 / 13!r} * n.v) / (pow({11 / 13!r}, p.g) + {2 / 13!r}) END,
        CASE WHEN n.v IS NULL THEN p.g + 1 ELSE 1 END FROM e p JOIN num n ON n.key = p.key AND n.rn = p.rn + 1)
    SELECT key, day, round(y, 4) AS ema_12 FROM e""",
)
def exponential_mean_over_gaps(spark, sf):
    """A quarter of the days has no price; older values lose weight with the days that pass."""
    rows = bars(spark, sf).withColumn("close", F.when(F.dayofmonth("day") % 4 != 0, F.col("close")))
    return _pick(s.exponential_averages(rows, BAR_AXIS, spans=(12,)), "ema_12")


_MACD_SQL = f"""WITH RECURSIVE {SQL_BARS}, num AS MATERIALIZED (SELECT key, day, close AS v, row_number() OVER {W} AS rn FROM bars),
    ema AS (SELECT key, day, rn, v, v AS f, v AS s, CAST(0 AS DOUBLE) AS g FROM num WHERE rn = 1
      UNION ALL SELECT n.key, n.day, n.rn, n.v, p.f * {11 / 13!r} + n.v * {2 / 13!r}, p.s * {25 / 27!r} + n.v * {2 / 27!r},
        p.g * 0.8 + ((p.f * {11 / 13!r} + n.v * {2 / 13!r}) - (p.s * {25 / 27!r} + n.v * {2 / 27!r})) * 0.2
      FROM ema p JOIN num n ON n.key = p.key AND n.rn = p.rn + 1)"""


@query(
    "macd_crossings",
    _MACD_SQL
    + """ SELECT key, day, round(f - s, 4) AS macd, round(g, 4) AS macd_signal, round(f - s - g, 4) AS macd_histogram,
    CAST(f - s > g AS INT) AS macd_cross_above, CAST(f - s < g AS INT) AS macd_cross_below FROM ema""",
)
def macd_crossings(spark, sf):
    out = s.macd(bars(spark, sf), BAR_AXIS)
    return out.select(
        "key", "day", *[r(c, 4).alias(c) for c in ("macd", "macd_signal", "macd_histogram")], "macd_cross_above", "macd_cross_below"
    )


_SQL_RSI = f"""chg AS (SELECT *, coalesce(close - lag(close) OVER {W}, 0) AS d FROM bars),
  gl AS (SELECT *, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM chg),
  gm AS (SELECT *, {FULL(14, 'avg', 'g')} AS gm, {FULL(14, 'avg', 'l')} AS lm FROM gl),
  rsi AS (SELECT *, CASE WHEN lm = 0 AND gm > 0 THEN 100.0 ELSE 100 - 100 / (1 + gm / nullif(lm, 0)) END AS rsi_14 FROM gm)"""


@query(
    "relative_strength",
    f"""{WITH}, {_SQL_RSI} SELECT key, day, round(rsi_14, 5) AS rsi_14, CAST(coalesce(rsi_14 < 30, false) AS INT) AS rsi_oversold,
    CAST(coalesce(rsi_14 > 70, false) AS INT) AS rsi_overbought FROM rsi""",
)
def relative_strength(spark, sf):
    out = s.rsi(bars(spark, sf), BAR_AXIS)
    return out.select("key", "day", r("rsi_14", 5).alias("rsi_14"), "rsi_oversold", "rsi_overbought")


@query(
    "bollinger_bands",
    f"""{WITH}, x AS (SELECT *, {FULL(20, 'avg', 'close')} AS m, {FULL(20, 'stddev_samp', 'close')} AS sd FROM bars)
    SELECT key, day, round(m, 4) AS bb_middle, round(m + 2 * sd, 4) AS bb_upper, round(m - 2 * sd, 4) AS bb_lower,
      round((close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0), 6) AS bb_position,
      round(((m + 2 * sd) - (m - 2 * sd)) / nullif(m, 0), 6) AS bb_width FROM x""",
)
def bollinger_bands(spark, sf):
    out = s.bollinger(bars(spark, sf), BAR_AXIS)
    return out.select(
        "key", "day", *[r(c, 4).alias(c) for c in ("bb_middle", "bb_upper", "bb_lower")],
        *[r(c, 6).alias(c) for c in ("bb_position", "bb_width")],
    )


@query(
    "returns_and_volatility",
    f"""{WITH}, x AS (SELECT *, {RET} AS daily_return, ln(close / lag(close) OVER {W}) AS log_return FROM bars)
    SELECT key, day, round(daily_return, 6) AS daily_return, round(log_return, 6) AS log_return,
      round({FULL(5, 'stddev_samp', 'daily_return')}, 6) AS volatility_5d, round({FULL(20, 'stddev_samp', 'daily_return')}, 6) AS volatility_20d FROM x""",
)
def returns_and_volatility(spark, sf):
    out = s.volatility(s.returns(bars(spark, sf), BAR_AXIS), BAR_AXIS)
    return _pick(out, "daily_return", "log_return", "volatility_5d", "volatility_20d", digits=6)


@query(
    "volume_averages",
    f"""{WITH}, x AS (SELECT *, {FULL(5, 'avg', 'volume')} AS volume_sma_5, {FULL(20, 'avg', 'volume')} AS volume_sma_20 FROM bars)
    SELECT key, day, round(volume_sma_5, 6) AS volume_sma_5, round(volume_sma_20, 6) AS volume_sma_20,
      round(volume / nullif(volume_sma_5, 0), 6) AS volume_ratio_5, round(volume / nullif(volume_sma_20, 0), 6) AS volume_ratio_20 FROM x""",
)
def volume_averages(spark, sf):
    return _pick(s.volume_features(bars(spark, sf), BAR_AXIS), "volume_sma_5", "volume_sma_20", "volume_ratio_5", "volume_ratio_20", digits=6)


@query(
    "support_resistance_levels",
    f"""{WITH}, x AS (SELECT *, {FULL(20, 'max', 'close')} AS hi, {FULL(20, 'min', 'close')} AS lo FROM bars)
    SELECT key, day, round(hi, 4) AS rolling_high, round(lo, 4) AS rolling_low, round((hi - close) / close, 6) AS dist_from_resistance,
      round((close - lo) / close, 6) AS dist_from_support FROM x""",
)
def support_resistance_levels(spark, sf):
    out = s.support_resistance(bars(spark, sf), BAR_AXIS)
    return out.select(
        "key", "day", *[r(c, 4).alias(c) for c in ("rolling_high", "rolling_low")],
        *[r(c, 6).alias(c) for c in ("dist_from_resistance", "dist_from_support")],
    )


@query(
    "stochastic_oscillator",
    f"""{WITH}, x AS (SELECT *, {FULL(14, 'max', 'high')} AS hh, {FULL(14, 'min', 'low')} AS ll FROM bars),
    y AS (SELECT *, (close - ll) / nullif(hh - ll, 0) * 100 AS stoch_k FROM x)
    SELECT key, day, round(stoch_k, 5) AS stoch_k, round({FULL(3, 'avg', 'stoch_k')}, 5) AS stoch_d FROM y""",
)
def stochastic_oscillator(spark, sf):
    return _pick(s.stochastic(bars(spark, sf), BAR_AXIS), "stoch_k", "stoch_d", digits=5)


@query(
    "rate_of_change_momentum",
    f"""{WITH} SELECT key, day, {', '.join(f'round((close / lag(close, {n}) OVER {W} - 1) * 100, 4) AS roc_{n}' for n in (1, 5, 20))},
      {', '.join(f'round(close / lag(close, {n}) OVER {W} - 1, 6) AS momentum_{n}' for n in (5, 20))} FROM bars""",
)
def rate_of_change_momentum(spark, sf):
    out = s.momentum(bars(spark, sf), BAR_AXIS)
    return out.select(
        "key", "day", *[r(f"roc_{n}", 4).alias(f"roc_{n}") for n in (1, 5, 20)],
        *[r(f"momentum_{n}", 6).alias(f"momentum_{n}") for n in (5, 20)],
    )


@query(
    "annualised_volatility",
    f"""{WITH}, x AS (SELECT *, {RET} AS ret FROM bars)
    SELECT key, day, round({FULL(20, 'stddev_samp', 'ret')} * sqrt(252) * 100, 4) AS volatility_20,
      round({FULL(50, 'stddev_samp', 'ret')} * sqrt(252) * 100, 4) AS volatility_50 FROM x""",
)
def annualised_volatility(spark, sf):
    return _pick(s.annual_volatility(bars(spark, sf), BAR_AXIS), "volatility_20", "volatility_50")


@query(
    "average_true_range",
    f"""{WITH}, x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS true_range,
       abs(close - lag(close) OVER {W}) AS mv FROM bars)
    SELECT key, day, round(true_range, 4) AS true_range, round({FULL(14, 'avg', 'true_range')}, 4) AS atr_14,
      round(coalesce({FULL(14, 'avg', 'mv')}, 0.1), 4) AS close_atr FROM x""",
)
def average_true_range(spark, sf):
    out = s.close_range(s.true_range(bars(spark, sf), BAR_AXIS), BAR_AXIS)
    return _pick(out, "true_range", "atr_14", "close_atr")


_LAGS = (1, 2, 3, 5, 7, 14, 21, 30)


@query(
    "lagged_features",
    f"""{WITH} SELECT key, day, {', '.join(f'lag(close, {n}) OVER {W} AS close_lag_{n}' for n in _LAGS)},
      {', '.join(f'round(close - lag(close, {n}) OVER {W}, 4) AS close_diff_{n}' for n in (1, 2, 3))},
      {', '.join(f'round(close / lag(close, {n}) OVER {W} - 1, 6) AS close_pct_change_{n}' for n in (1, 2, 3, 5))} FROM bars""",
)
def lagged_features(spark, sf):
    out = s.lag_features(bars(spark, sf), BAR_AXIS, ["close"])
    return out.select(
        "key", "day", *[f"close_lag_{n}" for n in _LAGS],
        *[r(f"close_diff_{n}", 4).alias(f"close_diff_{n}") for n in (1, 2, 3)],
        *[r(f"close_pct_change_{n}", 6).alias(f"close_pct_change_{n}") for n in (1, 2, 3, 5)],
    )


@query(
    "short_lag_set",
    f"""{WITH} SELECT key, day, {', '.join(f'lag({c}, {n}) OVER {W} AS {c}_lag_{n}' for c in ('open', 'high', 'low') for n in (1, 3, 7))},
      {', '.join(f'round({c} - lag({c}, {n}) OVER {W}, 4) AS {c}_momentum_{n}' for c in ('open', 'high', 'low') for n in (1, 3))} FROM bars""",
)
def short_lag_set(spark, sf):
    cols = ("open", "high", "low")
    out = s.lag_features(bars(spark, sf), BAR_AXIS, cols, lags=(1, 3, 7), diffs=(), changes=(), momentums=(1, 3))
    return out.select(
        "key", "day", *[f"{c}_lag_{n}" for c in cols for n in (1, 3, 7)],
        *[r(f"{c}_momentum_{n}", 4).alias(f"{c}_momentum_{n}") for c in cols for n in (1, 3)],
    )


_ROLL = {
    "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "median": "quantile_cont({c}, 0.5)",
    "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)",
}


def _sql_roll(c: str, n: int, stat: str, part: str = "key", order: str = "day") -> str:
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN {_ROLL[stat].format(c=c)} OVER {w} END AS {c}_rolling_{stat}_{n}"


def _sql_rolling(windows) -> str:
    inner = ", ".join(_sql_roll("close", n, st) for n in windows for st in _ROLL)
    outer = ", ".join(f"round(close_rolling_{st}_{n}, 4) AS close_rolling_{st}_{n}" for n in windows for st in _ROLL)
    rel = ", ".join(
        f"round(close / nullif(close_rolling_mean_{n}, 0) - 1, 6) AS close_vs_rolling_mean_{n}, "
        f"round((close - close_rolling_mean_{n}) / nullif(close_rolling_std_{n}, 0), 6) AS close_zscore_{n}" for n in windows
    )
    return f"{WITH}, x AS (SELECT *, {inner} FROM bars) SELECT key, day, {outer}, {rel} FROM x"


def _rolling_query(windows):
    def run(spark, sf):
        out = s.rolling_features(bars(spark, sf), BAR_AXIS, ["close"], windows)
        digits = {f"close_rolling_{st}_{n}": 4 for n in windows for st in _ROLL}
        return rounded(out, ["key", "day"], digits | {c: 6 for n in windows for c in (f"close_vs_rolling_mean_{n}", f"close_zscore_{n}")})

    return run


query("rolling_statistics_short", _sql_rolling((3, 5, 7)))(_rolling_query((3, 5, 7)))
query("rolling_statistics_long", _sql_rolling((10, 14, 20, 30)))(_rolling_query((10, 14, 20, 30)))


@query(
    "compact_rolling_set",
    f"""{WITH}, x AS (SELECT *, {', '.join(_sql_roll(c, n, st) for c in ('close', 'volume') for n in (5, 10, 20) for st in ('mean', 'std', 'min', 'max'))} FROM bars)
    SELECT key, day, {', '.join(f'round({c}_rolling_{st}_{n}, 4) AS {c}_rolling_{st}_{n}' for c in ('close', 'volume') for n in (5, 10, 20) for st in ('mean', 'std', 'min', 'max'))} FROM x""",
)
def compact_rolling_set(spark, sf):
    stats = ("mean", "std", "min", "max")
    out = s.rolling_features(bars(spark, sf), BAR_AXIS, ["close", "volume"], (5, 10, 20), stats, relative=False)
    return rounded(out, ["key", "day"], {f"{c}_rolling_{st}_{n}": 4 for c in ("close", "volume") for n in (5, 10, 20) for st in stats})


# -- the same windows on raw events, where one user may hold a third of the table ---------------

_TW = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _tick_axis(rows: int):
    from dataclasses import replace

    return replace(TICK_AXIS, block_rows=rows)


@query(
    "tick_rolling_features",
    f"""WITH x AS (SELECT *, {FULL(5, 'avg', 'value', 'user_id', 'ts, event_id')} AS m, {FULL(20, 'stddev_samp', 'value', 'user_id', 'ts, event_id')} AS sd,
       lag(value) OVER {_TW} AS l, lead(value) OVER {_TW} AS nx FROM events)
    SELECT user_id, event_id, round(m, 6) AS value_rolling_mean_5, round(sd, 6) AS value_rolling_std_20, l AS value_lag_1, nx AS value_lead_1 FROM x""",
)
def tick_rolling_features(spark, sf):
    """Rolling features of raw events in blocks of rows, so a hot user is spread over many tasks."""
    from marketweave.operators.axis import apply_stages

    stage = {
        "m": lambda f: f.full(5, F.avg, "value"),
        "sd": lambda f: f.full(20, F.stddev_samp, "value"),
        "value_lag_1": lambda f: f.lag("value"),
        "value_lead_1": lambda f: f.lead("value"),
    }
    out = apply_stages(ticks(spark, sf), TICK_AXIS, [stage], back=19, ahead=1)
    return out.select(
        "user_id", "event_id", r("m").alias("value_rolling_mean_5"), r("sd").alias("value_rolling_std_20"), "value_lag_1", "value_lead_1"
    )


@query(
    "tick_running_drawdown",
    f"""WITH x AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mx,
        sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sm FROM events)
    SELECT user_id, event_id, mx AS running_max, round(value / nullif(mx, 0) - 1, 6) AS drawdown, round(sm, 4) AS running_sum FROM x""",
)
def tick_running_drawdown(spark, sf):
    from marketweave.operators.axis import running

    out = s.drawdown(ticks(spark, sf), TICK_AXIS, "value")
    out = running(out, TICK_AXIS, {"running_sum": ("sum", F.col("value"))})
    return out.select("user_id", "event_id", "running_max", r("drawdown").alias("drawdown"), r("running_sum", 4).alias("running_sum"))


# -- sentiment panels -------------------------------------------------------------------------

_SQL_SENT = f"""{SQL_NEWS}, panel AS (SELECT b.*, n.news_count, n.news_sentiment,
    coalesce(n.news_sentiment, 0) * 0.6 + coalesce(b.trades / 10.0, 0) * 0.4 AS combined_sentiment
  FROM bars b LEFT JOIN news n ON b.day = n.day)"""


def _panel(spark, sf):
    from marketweave.functions.scalar import weighted_sentiment

    # one row per calendar day: limited by the calendar, not by the data
    joined = bars(spark, sf).join(F.broadcast(daily_orders(spark, sf)), "day", "left")
    return joined.withColumn("combined_sentiment", weighted_sentiment(F.col("news_sentiment"), F.col("trades") / 10.0))


@query(
    "sentiment_moving_averages",
    f"""{WITH}, {_SQL_SENT} SELECT key, day, round(combined_sentiment, 6) AS combined_sentiment,
      round(avg(combined_sentiment) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS combined_sentiment_3d_ma,
      round(avg(combined_sentiment) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS combined_sentiment_7d_ma,
      round(coalesce(combined_sentiment / nullif(lag(combined_sentiment) OVER {W}, 0) - 1, 0), 3) AS combined_sentiment_change,
      round(volume * abs(combined_sentiment), 4) AS volume_sentiment,
      round(volume * abs(combined_sentiment) / (avg(volume) OVER (PARTITION BY key) + 1), 6) AS volume_sentiment_ratio FROM panel""",
)
def sentiment_moving_averages(spark, sf):
    from marketweave.functions.scalar import volume_sentiment

    out = volume_sentiment(s.sentiment_momentum(_panel(spark, sf), BAR_AXIS), BAR_AXIS)
    return out.select(
        "key", "day", *[r(c).alias(c) for c in ("combined_sentiment", "combined_sentiment_3d_ma", "combined_sentiment_7d_ma")],
        r("combined_sentiment_change", 3).alias("combined_sentiment_change"),
        r("volume_sentiment", 4).alias("volume_sentiment"), r("volume_sentiment_ratio").alias("volume_sentiment_ratio"),
    )


@query(
    "activity_spike_flags",
    f"""{WITH} SELECT key, day, trades, CAST(coalesce(trades > 1.5 * {FULL(7, 'avg', 'trades')}, false) AS INT) AS trades_spike,
      round(trades / (max(trades) OVER (PARTITION BY key) + 1), 6) AS trades_normalized FROM bars""",
)
def activity_spike_flags(spark, sf):
    out = s.activity_spikes(bars(spark, sf), BAR_AXIS, "trades")
    return out.select("key", "day", "trades", "trades_spike", r("trades_normalized").alias("trades_normalized"))


@query(
    "price_sentiment_divergence",
    f"""{WITH}, {_SQL_SENT}, x AS (SELECT *, coalesce({RET}, 0) - coalesce(combined_sentiment - lag(combined_sentiment) OVER {W}, 0) AS dv FROM panel)
    SELECT key, day, round(dv, 6) AS price_sentiment_divergence, CASE WHEN dv > 0.02 THEN 1 WHEN dv < -0.02 THEN -1 ELSE 0 END AS divergence_signal FROM x""",
)
def price_sentiment_divergence(spark, sf):
    out = s.price_sentiment_divergence(_panel(spark, sf), BAR_AXIS)
    return out.select("key", "day", r("price_sentiment_divergence").alias("price_sentiment_divergence"), "divergence_signal")


@query(
    "composite_scores",
    f"""{WITH}, {_SQL_SENT}, x AS (SELECT *, {RET} AS ret FROM panel)
    SELECT key, day, round((combined_sentiment + coalesce({FULL(5, 'avg', 'ret')}, 0)) / 2, 6) AS composite_score FROM x""",
)
def composite_scores(spark, sf):
    return _pick(s.composite_score(_panel(spark, sf), BAR_AXIS), "composite_score", digits=6)


# -- cumulative and regimes -------------------------------------------------------------------


@query(
    "drawdown_curve",
    f"""{WITH}, x AS (SELECT *, max(close) OVER (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING) AS mx FROM bars)
    SELECT key, day, round(mx, 4) AS running_max, round(close / mx - 1, 6) AS drawdown FROM x""",
)
def drawdown_curve(spark, sf):
    out = s.drawdown(bars(spark, sf), BAR_AXIS)
    return out.select("key", "day", r("running_max", 4).alias("running_max"), r("drawdown").alias("drawdown"))


@query(
    "cumulative_returns",
    f"""{WITH}, x AS (SELECT *, first_value(close) OVER {W} AS c0 FROM bars)
    SELECT key, day, round(close / c0 - 1, 5) AS cumulative_return FROM x""",
)
def cumulative_returns(spark, sf):
    return _pick(s.cumulative_return(bars(spark, sf), BAR_AXIS), "cumulative_return", digits=5)


_FALLEN = "CASE WHEN key % 10 = 3 AND day >= DATE '1997-01-01' THEN 0 WHEN day(day) = 5 THEN -close ELSE close END"


@query(
    "cumulative_returns_to_nothing",
    f"""{WITH}, p AS (SELECT key, day, {_FALLEN} AS p FROM bars), x AS (SELECT *, first_value(p) OVER {W} AS p0, bool_or(p = 0) OVER {W} AS gone FROM p)
    SELECT key, day, round(CASE WHEN gone THEN -1.0 ELSE p / p0 - 1 END, 5) AS cumulative_return FROM x""",
)
def cumulative_returns_to_nothing(spark, sf):
    """Some prices fall to zero for good, some are negative for a day."""
    rows = bars(spark, sf).withColumn("close", F.expr(_FALLEN))
    return _pick(s.cumulative_return(rows, BAR_AXIS), "cumulative_return", digits=5)


@query(
    "return_autocorrelation",
    f"""{WITH}, x AS (SELECT key, day, {RET} AS a FROM bars), y AS (SELECT *, lag(a) OVER {W} AS b FROM x)
    SELECT key, round(corr(a, b), 6) AS autocorr_1, count(b) AS pairs FROM y GROUP BY key""",
)
def return_autocorrelation(spark, sf):
    return s.return_autocorrelation(bars(spark, sf), BAR_AXIS).select("key", r("autocorr_1").alias("autocorr_1"), "pairs")


@query(
    "regime_vectors",
    f"""{WITH}, x AS (SELECT *, {RET} AS ret, close / lag(close, 20) OVER {W} - 1 AS m FROM bars)
    SELECT key, day, round(ret, 6) AS daily_return, round(m, 6) AS momentum_20, round({FULL(20, 'stddev_samp', 'ret')}, 6) AS volatility_20d FROM x""",
)
def regime_vectors(spark, sf):
    return _pick(s.regime_vector(bars(spark, sf), BAR_AXIS), "daily_return", "momentum_20", "volatility_20d", digits=6)


@query(
    "volatility_surface",
    f"""{WITH}, x AS (SELECT *, {RET} AS ret FROM bars) """
    + " UNION ALL ".join(
        f"SELECT key, day, {n} AS horizon, round({FULL(n, 'stddev_samp', 'ret')} * sqrt(252), 5) AS volatility FROM x" for n in (5, 10, 20, 50, 100)
    ),
)
def volatility_surface(spark, sf):
    return _pick(s.volatility_surface(bars(spark, sf), BAR_AXIS), "volatility", digits=5, keep=("horizon",))


@query(
    "trend_regime_flags",
    f"""{WITH}, x AS (SELECT *, {FULL(20, 'avg', 'close')} AS a, {FULL(50, 'avg', 'close')} AS b FROM bars)
    SELECT key, day, CAST(a > b AS INT) AS bull_regime FROM x""",
)
def trend_regime_flags(spark, sf):
    return s.regime_flag(bars(spark, sf), BAR_AXIS).select("key", "day", "bull_regime")


@query(
    "market_regime_labels",
    f"""{WITH}, x AS (SELECT *, {RET} AS ret FROM bars),
    y AS (SELECT *, {FULL(50, 'stddev_samp', 'ret')} AS sd50, {FULL(20, 'avg', 'close')} - {FULL(50, 'avg', 'close')} AS tr,
          {FULL(20, 'avg', 'volume')} > {FULL(50, 'avg', 'volume')} AS vt, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS back FROM x),
    g AS (SELECT key, count(*) AS bars, stddev_samp(ret) AS vol, avg(sd50) AS asd, coalesce(max(CASE WHEN back = 1 THEN tr END), 0) AS trend,
          coalesce(bool_or(CASE WHEN back = 1 THEN vt END), true) AS rising FROM y GROUP BY key)
    SELECT key, bars, round(vol, 6) AS volatility, round(trend, 4) AS trend,
      CASE WHEN bars <= 20 THEN 'NEUTRAL' WHEN vol > 1.5 * coalesce(asd, vol) THEN 'HIGH_VOLATILITY' WHEN trend > 0 AND rising THEN 'BULLISH'
           WHEN trend < 0 AND rising THEN 'BEARISH' ELSE 'NEUTRAL' END AS regime FROM g""",
)
def market_regime_labels(spark, sf):
    out = s.market_regime(bars(spark, sf), BAR_AXIS)
    return out.select("key", "bars", r("volatility").alias("volatility"), r("trend", 4).alias("trend"), "regime")


@query(
    "latest_indicator_snapshot",
    _MACD_SQL
    + f""", {_SQL_RSI}, x AS (SELECT *, {RET} AS ret, abs(close - lag(close) OVER {W}) AS mv,
        row_number() OVER (PARTITION BY key ORDER BY day DESC) AS back FROM rsi),
    y AS (SELECT *, {FULL(20, 'avg', 'close')} AS s20, {FULL(50, 'avg', 'close')} AS s50, {FULL(20, 'stddev_samp', 'close')} AS sd,
        {FULL(20, 'avg', 'volume')} AS vs, {FULL(20, 'stddev_samp', 'ret')} AS v20, {FULL(14, 'avg', 'mv')} AS atr FROM x),
    g AS (SELECT key, avg(close) AS mp, max(close) AS xp, min(close) AS np, avg(volume) AS mvol FROM bars GROUP BY key)
    SELECT y.key, round(y.close, 4) AS price, round(coalesce(s20, mp), 4) AS sma_20, round(coalesce(s50, mp), 4) AS sma_50,
      round(f - s, 4) AS macd, round(g, 4) AS macd_signal, round(coalesce(rsi_14, 50), 4) AS rsi,
      round(coalesce(s20 + 2 * sd, xp), 4) AS bb_upper, round(coalesce(s20 - 2 * sd, np), 4) AS bb_lower,
      round(coalesce((y.close - (s20 - 2 * sd)) / nullif(4 * sd, 0), 0.5), 6) AS bb_position,
      round(y.volume / nullif(coalesce(vs, mvol), 0), 6) AS volume_ratio, round(coalesce(v20, 0.1), 6) AS volatility_20d, round(coalesce(atr, 0.1), 4) AS atr
    FROM y JOIN g ON y.key = g.key JOIN ema e ON e.key = y.key AND e.day = y.day WHERE back = 1""".replace(
        "round(g, 4) AS macd_signal", "round(e.g, 4) AS macd_signal"
    ),
)
def latest_indicator_snapshot(spark, sf):
    out = s.latest_snapshot(bars(spark, sf), BAR_AXIS)
    four = ("price", "sma_20", "sma_50", "macd", "macd_signal", "rsi", "bb_upper", "bb_lower", "atr")
    return out.select(
        "key", *[r(c, 4).alias(c) for c in four], *[r(c).alias(c) for c in ("bb_position", "volume_ratio", "volatility_20d")]
    )


@query(
    "regular_frequency_check",
    f"""{WITH}, x AS (SELECT key, date_diff('day', lag(day) OVER {W}, day) AS gap FROM bars), c AS (SELECT key, gap, count(*) AS n FROM x WHERE gap IS NOT NULL GROUP BY ALL),
    g AS (SELECT key, sum(n) AS gaps, max(n) AS top FROM c GROUP BY key),
    m AS (SELECT c.key, min(gap) AS modal_gap FROM c JOIN g ON c.key = g.key AND c.n = g.top GROUP BY c.key)
    SELECT g.key, m.modal_gap, CAST(g.gaps AS BIGINT) AS gaps, round(top / gaps, 6) AS modal_share, CAST(top / gaps > 0.8 AS INT) AS is_regular FROM g JOIN m ON g.key = m.key""",
)
def regular_frequency_check(spark, sf):
    out = s.regular_frequency(bars(spark, sf), BAR_AXIS, unit_seconds=86400)
    return out.select("key", "modal_gap", "gaps", r("modal_share").alias("modal_share"), "is_regular")


@query(
    "fill_gaps_forward_backward",
    f"""WITH x AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
    SELECT user_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
      first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM x""",
)
def fill_gaps_forward_backward(spark, sf):
    df = ticks(spark, sf).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return s.fill_forward_backward(df, TICK_AXIS, ["v"]).select("user_id", "event_id", "v")


# -- labels -----------------------------------------------------------------------------------


@query(
    "next_day_labels",
    f"""{WITH}, x AS (SELECT *, lead(close) OVER {W} / close - 1 AS t FROM bars)
    SELECT key, day, round(t, 6) AS target_return, CAST(t > 0 AS INT) AS target_up,
      CASE WHEN t <= -0.02 THEN 'strong_down' WHEN t <= 0 THEN 'slight_down' WHEN t <= 0.02 THEN 'slight_up' ELSE 'strong_up' END AS movement
    FROM x WHERE t IS NOT NULL""",
)
def next_day_labels(spark, sf):
    out = lab.next_return(bars(spark, sf), BAR_AXIS)
    return out.select(
        "key", "day", r("target_return").alias("target_return"), "target_up", lab.movement_class(F.col("target_return")).alias("movement")
    )


@query(
    "forward_horizon_labels",
    f"""{WITH}, x AS (SELECT *, {RET} AS ret, {', '.join(f'lead(close, {h}) OVER {W} / close - 1 AS f{h}' for h in (3, 5, 10))} FROM bars),
    y AS (SELECT *, {FULL(5, 'stddev_samp', 'ret')} AS v FROM x)
    SELECT key, day, CAST(f3 > 0 AS INT) AS up_3d, CAST(f10 > 0 AS INT) AS up_10d, round(f5, 6) AS forward_return_5,
      round(lead(v) OVER {W}, 6) AS target_volatility FROM y""",
)
def forward_horizon_labels(spark, sf):
    out = lab.forward_direction(bars(spark, sf), BAR_AXIS)
    out = lab.forward_volatility(lab.forward_return(out, BAR_AXIS), BAR_AXIS)
    return out.select(
        "key", "day", "up_3d", "up_10d", r("forward_return_5").alias("forward_return_5"), r("target_volatility").alias("target_volatility")
    )


@query(
    "top_volatility_bars",
    f"""{WITH}, x AS (SELECT *, {RET} AS ret FROM bars), y AS (SELECT *, {FULL(20, 'stddev_samp', 'ret')} AS v FROM x)
    SELECT CAST(row_number() OVER (ORDER BY v DESC, key, day) AS INT) AS rank, key, day, round(v, 6) AS volatility_20d FROM y WHERE v IS NOT NULL ORDER BY v DESC, key, day LIMIT 20""",
)
def top_volatility_bars(spark, sf):
    out = s.volatility(bars(spark, sf), BAR_AXIS).dropna(subset=["volatility_20d"])
    return lab.top_k(out, F.col("volatility_20d"), ["key", "day"], 20).select("rank", "key", "day", r("volatility_20d").alias("volatility_20d"))


@query(
    "best_row_per_group",
    """SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1""",
)
def best_row_per_group(spark, sf):
    from marketweave.plans.roles import table

    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return lab.best_per_group(c, ["c_mktsegment"], F.col("c_acctbal"), ["c_custkey"])


@query(
    "quantile_class_buckets",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 1.0/3) AS a, quantile_cont(o_totalprice, 2.0/3) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 ELSE 2 END AS bucket FROM orders, q""",
)
def quantile_class_buckets(spark, sf):
    from marketweave.plans.roles import table

    return lab.quantile_buckets(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "bucket")


@query(
    "direction_classes",
    f"{WITH} SELECT key, day, CAST(close > lag(close) OVER {W} AS INT) AS direction FROM bars",
)
def direction_classes(spark, sf):
    return lab.direction_class(bars(spark, sf), BAR_AXIS, "close").select("key", "day", "direction")


@query(
    "chronological_split",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM x""",
)
def chronological_split(spark, sf):
    return lab.chronological_split(ticks(spark, sf), TICK_AXIS, 0.2).select("user_id", "event_id", "split")


@query(
    "expanding_time_folds",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT x.*, n // 4 AS size, fold FROM x, range(3) t(fold)), g AS (SELECT *, n - size * (3 - fold) AS st FROM f)
    SELECT user_id, event_id, CAST(fold AS INT) AS fold, CASE WHEN pos < st THEN 'train' ELSE 'test' END AS role FROM g WHERE pos < st + size""",
)
def expanding_time_folds(spark, sf):
    return lab.expanding_folds(ticks(spark, sf), TICK_AXIS, 3).select("user_id", "event_id", "fold", "role")


@query("stratified_random_split")
def stratified_random_split(spark, sf):
    from marketweave.plans.roles import table

    return lab.stratified_split(table(spark, sf, "labels"), "quality", ["doc_id"])
