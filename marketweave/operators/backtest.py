"""Path-dependent backtests, one independent fold per (strategy, symbol), and position keeping.

A fold is bounded by the calendar: it runs over daily rows. Thousands of folds run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.num import sdiv
from marketweave.operators.signals import ENHANCED_RISK, REGIME_FACTOR
from marketweave.session import cut, dealt


def commission(value: float) -> float:
    return max(value * 0.001, 1.0)


def run_backtest(
    df: DataFrame, keys: Sequence[str], day: str = "day", price: str = "close", capital: float = 100_000.0, min_confidence: float = 0.3
) -> DataFrame:
    """Long-only fold over signals (action, confidence, risk_level; regime and sentiment_score when
    present): one row per day with cash, quantity held, traded quantity and portfolio value."""
    keys = list(keys)
    for name, default in (("regime", F.lit("NEUTRAL")), ("sentiment_score", F.lit(0.0))):
        if name not in df.columns:
            df = df.withColumn(name, default)
    cols = [*keys, day, price, "action", "confidence", "risk_level", "regime", "sentiment_score"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {day} {types[day]}, {price} double, action string, confidence double, traded long, held long, cash double, portfolio_value double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        cash, held, out = capital, 0, []
        for p, act, conf, level, regime, mood in zip(pdf[price], pdf["action"], pdf["confidence"], pdf["risk_level"], pdf["regime"], pdf["sentiment_score"]):
            traded = 0
            if act in ("BUY", "SELL") and conf > min_confidence:
                base = ENHANCED_RISK.get(level, 0.020) * REGIME_FACTOR.get(regime, 1.0) * (1 + (0.0 if pd.isna(mood) else mood) * 0.3)
                size = max(cash * 0.005, min(cash * base * min(conf, 1.0), cash * 0.05))
                quantity = int(size / p)
                if quantity > 0 and act == "BUY" and size <= cash:
                    cash -= quantity * p + commission(quantity * p)
                    held, traded = held + quantity, quantity
                elif quantity > 0 and act == "SELL" and held > 0:
                    quantity = min(quantity, held)
                    cash += quantity * p - commission(quantity * p)
                    held, traded = held - quantity, -quantity
            out.append((traded, held, cash, cash + held * p))
        path = pd.DataFrame(out, columns=["traded", "held", "cash", "portfolio_value"], index=pdf.index)
        return pd.concat([pdf[[*keys, day, price, "action", "confidence"]], path], axis=1)

    return df.select(*cols).groupBy(*keys).applyInPandas(fold, schema)


def follow_book(state: tuple[int, float], trades: Iterable[tuple[str, int, float]]) -> tuple[tuple[int, float], list[tuple]]:
    """Average-cost book from (held, average price) on: the new state, and per trade what was
    executed, the position, its average price, the realised profit and whether it opened a short."""
    (held, avg), out = state, []
    for act, q, p in trades:
        q, done, pnl, short = int(q), 0, 0.0, False
        if act == "BUY" and q > 0:
            total = held + q
            if held < 0:  # buys the short back first
                covered = min(q, -held)
                pnl = covered * (avg - p) - commission(covered * p)
                avg = p if total > 0 else avg if total else 0.0
            else:
                avg = (held * avg + q * p) / total
            held, done = total, q
        elif act == "SELL" and q > 0 and held > 0:
            done = min(q, held)
            pnl = done * (p - avg) - commission(done * p)
            held -= done
            avg = avg if held else 0.0
        elif act == "SELL" and q > 0 and held == 0:
            held, avg, done, short = -q, p, q, True
        out.append((done, held, avg, pnl, short))
    return (held, avg), out


def keep_positions(trades: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Average-cost book over (action, quantity, price): position, average price, realised profit.
    Selling more than held is cut to what is held; selling with nothing held opens a short."""
    keys, order = list(keys), list(order)
    types = {f.name: f.dataType.simpleString() for f in trades.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, *order]) + ", action string, executed long, price double, position long, avg_price double, pnl double, is_short boolean"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        _, out = follow_book((0, 0.0), zip(pdf["action"], pdf["quantity"], pdf["price"]))
        book = pd.DataFrame(out, columns=["executed", "position", "avg_price", "pnl", "is_short"], index=pdf.index)
        out_cols = [*keys, *order, "action", "executed", "price", "position", "avg_price", "pnl", "is_short"]
        return pd.concat([pdf[[*keys, *order, "action", "price"]], book], axis=1)[out_cols]

    return trades.groupBy(*keys).applyInPandas(fold, schema)


def trade_pairs(trades: DataFrame, keys: Sequence[str], day: str = "day", price: str = "close") -> DataFrame:
    """Sells directly after a buy, with return and holding days."""
    w = Window.partitionBy(*keys).orderBy(day)
    carried = [c for c in ("confidence", "sentiment_score") if c in trades.columns]
    prev = trades.withColumns(
        {"__a": F.lag("action").over(w), "__p": F.lag(price).over(w), "entry_day": F.lag(day).over(w), **{f"entry_{c}": F.lag(c).over(w) for c in carried}}
    )
    return prev.filter((F.col("action") == "SELL") & (F.col("__a") == "BUY")).select(
        *keys, "entry_day", F.col(day).alias("exit_day"), (sdiv(price, "__p") - 1).alias("trade_return"),
        F.date_diff(F.col(day), F.col("entry_day")).alias("holding_days"), *[f"entry_{c}" for c in carried],
    )


def performance(path: DataFrame, keys: Sequence[str], day: str = "day", price: str = "close") -> DataFrame:
    """Return, volatility, Sharpe, drawdown and its duration, trades, win rate, profit factor, Calmar."""
    keys = list(keys)
    path = cut(path)  # read twice, by the curve and by the trades: the fold behind it runs once
    path = dealt(path, path.count(), *keys)
    w = Window.partitionBy(*keys).orderBy(day)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("portfolio_value")
    rows = (
        path.withColumn("__ret", sdiv(v, F.lag(v).over(w)) - 1)
        .withColumns({"__peak": F.max(v).over(upto), "__before": F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))})
        .withColumn("__new", (v > F.col("__before")).cast("int"))
        .withColumn("__run", F.sum(F.coalesce(F.col("__new"), F.lit(0))).over(upto))
    )
    length = F.sum(F.when(F.coalesce(F.col("__new"), F.lit(0)) == 1, 0).otherwise(1)).over(Window.partitionBy(*keys, "__run").orderBy(day))
    rows = rows.withColumn("__under", length)
    eq = rows.groupBy(*keys).agg(
        (sdiv(F.max_by(v, day), F.min_by(v, day)) - 1).alias("total_return"),
        F.count("__ret").alias("__n"),
        F.avg("__ret").alias("__mean"),
        (F.stddev_pop("__ret") * F.sqrt(F.lit(252.0))).alias("volatility"),
        F.max(sdiv(F.col("__peak") - v, F.col("__peak"))).alias("max_drawdown"),
        F.max("__under").alias("drawdown_duration"),
        F.count_if(F.col("traded") != 0).alias("total_trades"),
    )
    pairs = trade_pairs(path.filter(F.col("traded") != 0), keys, day, price)
    r = F.col("trade_return")
    tr = pairs.groupBy(*keys).agg(
        F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_trade_return"),
        sdiv(F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"),
    )
    annual = F.col("total_return") * 252 / F.col("__n")
    return eq.join(tr, keys, "left").select(
        *keys, "total_return", F.when(F.col("__n") > 0, annual).otherwise(0.0).alias("annualized_return"), "volatility",
        F.coalesce(F.when(F.col("volatility") > 0, F.col("__mean") * 252 / F.col("volatility")), F.lit(0.0)).alias("sharpe_ratio"),
        "max_drawdown", "drawdown_duration", "total_trades", F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        F.coalesce("avg_trade_return", F.lit(0.0)).alias("avg_trade_return"), "profit_factor",
        F.when(F.col("max_drawdown") > 0, annual / F.col("max_drawdown")).alias("calmar_ratio"),
    )


def buy_and_hold(df: DataFrame, keys: Sequence[str], day: str = "day", price: str = "close") -> DataFrame:
    return df.groupBy(*keys).agg((sdiv(F.max_by(price, day), F.min_by(price, day)) - 1).alias("buy_hold_return"))


def compare_strategies(perf: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Mean metrics per strategy and flags for the best by Sharpe and by return (few rows). Means
    are compared at nine digits, so that equal strategies tie; ties go to the last name."""
    m = perf.groupBy(strategy).agg(
        F.count(F.lit(1)).alias("symbols"), F.avg("total_return").alias("total_return"), F.avg("sharpe_ratio").alias("sharpe_ratio"), F.avg("max_drawdown").alias("max_drawdown"),
        F.sum("total_trades").alias("total_trades"),
    )
    best = m.agg(*[F.max_by(strategy, F.struct(F.round(c, 9), strategy)).alias(n) for c, n in (("sharpe_ratio", "__s"), ("total_return", "__r"))])
    return m.crossJoin(F.broadcast(best)).withColumns(  # one row
        {"best_sharpe": (F.col(strategy) == F.col("__s")).cast("int"), "best_return": (F.col(strategy) == F.col("__r")).cast("int")}
    ).drop("__s", "__r")


def portfolio_value(positions: DataFrame, prices: DataFrame, cash: DataFrame, portfolio: str, symbol: str) -> DataFrame:
    """cash + signed quantity * price per portfolio."""
    held = positions.join(prices, symbol).groupBy(portfolio).agg(F.sum(F.col("quantity") * F.col("price")).alias("__v"))
    return cash.join(held, portfolio, "left").select(portfolio, (F.col("cash") + F.coalesce("__v", F.lit(0.0))).alias("portfolio_value"))


def daily_pnl(trades: DataFrame, keys: Sequence[str], ts: str, pnl: str = "pnl") -> DataFrame:
    return trades.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.sum(pnl).alias("pnl"), F.count(F.lit(1)).alias("trades"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate")
    )


def attribution(pairs: DataFrame) -> DataFrame:
    """Winning and losing trades side by side: size, mean return, confidence, holding days, and how
    confidence moves with the return."""
    c = [x for x in ("entry_confidence", "entry_sentiment_score") if x in pairs.columns]
    r = F.col("trade_return")
    return pairs.groupBy((r > 0).cast("int").alias("won")).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(r).alias("avg_return"), F.avg("holding_days").alias("avg_holding_days"),
        *[F.avg(x).alias(f"avg_{x}") for x in c], *[F.corr(x, "trade_return").alias(f"{x}_correlation") for x in c],
    )


def attribution_difference(groups: DataFrame) -> DataFrame:
    names = [c for c in groups.columns if c.startswith("avg_")]
    side = lambda c, w: F.max(F.when(F.col("won") == w, F.col(c)))
    return groups.agg(*[(side(c, 1) - side(c, 0)).alias(f"{c[4:]}_difference") for c in names])
