"""Trading signals, their adjustments, position sizes and pre-trade checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.num import clip, sdiv

# Fixed values of the rules below: thresholds, multipliers, tiers.
VOL_HIGH, VOL_MID = 0.15, 0.10
THRESHOLDS = (0.028, 0.022, 0.018)
MULTIPLIERS = (0.5, 0.7, 1.0)
RISK_LEVELS = ((0.22, "HIGH"), (0.16, "MEDIUM-HIGH"), (0.12, "MEDIUM"), (0.08, "LOW-MEDIUM"))
BASE_RISK = {"HIGH": 0.012, "MEDIUM-HIGH": 0.012, "MEDIUM": 0.018}
VOL_FACTOR = {"HIGH": 0.35, "MEDIUM-HIGH": 0.55, "MEDIUM": 0.75}
ENHANCED_RISK = {"HIGH": 0.010, "MEDIUM": 0.020, "LOW": 0.030}
REGIME_FACTOR = {"HIGH_VOLATILITY": 0.7, "BULLISH": 1.1, "BEARISH": 0.9}


def _lookup(c: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def threshold_signal(df: DataFrame, ret: str = "predicted_return", threshold: float = 0.02) -> DataFrame:
    r = F.col(ret)
    strength = F.least(F.abs(r) / threshold, F.lit(1.0))
    return df.withColumns(
        {
            "action": F.when(r > threshold, "BUY").when(r < -threshold, "SELL").when(r.isNotNull(), "HOLD"),
            "confidence": F.when(F.abs(r) > threshold, strength).when(r.isNotNull(), 0.0),
        }
    )


def adaptive_signal(df: DataFrame, ret: str = "predicted_return", vol: str = "predicted_volatility") -> DataFrame:
    """Threshold and confidence depend on the predicted volatility."""
    out = df.withColumns({ret: clip(F.col(ret), -0.15, 0.15), vol: clip(F.col(vol), 0.05, 0.35)})
    r, v = F.col(ret), F.col(vol)
    by_vol = lambda vals: F.when(v > VOL_HIGH, vals[0]).when(v > VOL_MID, vals[1]).otherwise(vals[2])
    tau, mult = by_vol(THRESHOLDS), by_vol(MULTIPLIERS)
    calm = v < 0.3
    buy, sell = (r > tau) & calm, (r < -tau) & calm
    conf = F.when(buy | sell, F.least(F.abs(r) / tau, F.lit(0.95)) * mult).when(F.abs(r) < 0.008, 0.18).otherwise(0.12)
    level = F.lit("LOW")
    for edge, name in reversed(RISK_LEVELS):
        level = F.when(v > edge, name).otherwise(level)
    known = r.isNotNull() & v.isNotNull()
    return out.withColumns(
        {
            "threshold_used": F.when(known, tau),
            "action": F.when(known, F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD")),
            "confidence": F.when(known, clip(conf, 0.08, 0.95)),
            "risk_level": F.when(known, level),
        }
    )


def adjust_technical(df: DataFrame, rsi: str = "rsi_14", macd: str = "macd", signal: str = "macd_signal") -> DataFrame:
    r = F.coalesce(rsi, F.lit(50.0))
    up = F.coalesce(macd, F.lit(0.0)) > F.coalesce(signal, F.lit(0.0))
    down = F.coalesce(macd, F.lit(0.0)) < F.coalesce(signal, F.lit(0.0))
    buy, sell = F.col("action") == "BUY", F.col("action") == "SELL"
    boost = (
        F.when(buy & (r < 70) & up, 0.15).when(buy & (r > 70), -0.10).when(sell & (r > 30) & down, 0.15).when(sell & (r < 30), -0.10).otherwise(0.0)
    )
    return df.withColumn("confidence", clip(F.col("confidence") + boost, 0.05, 0.95))


def adjust_sentiment(df: DataFrame, score: str = "sentiment_score") -> DataFrame:
    impact = F.coalesce(score, F.lit(0.0)) * 0.2
    act, conf = F.col("action"), F.col("confidence")
    agrees = ((act == "BUY") & (impact > 0)) | ((act == "SELL") & (impact < 0))
    flip = (act == "HOLD") & (F.abs(impact) > 0.1) & (conf < 0.3)
    new_conf = F.when(agrees, F.least(F.lit(0.95), conf + F.abs(impact))).when(flip, F.lit(0.4)).otherwise(conf)
    new_ret = F.when(agrees, F.col("predicted_return") * (1 + impact)).otherwise(F.col("predicted_return"))
    new_act = F.when(flip & (impact > 0), "BUY").when(flip & (impact < 0), "SELL").otherwise(act)
    return df.withColumns({"confidence": new_conf, "predicted_return": new_ret, "action": new_act})


def adjust_regime(df: DataFrame, regime: str = "regime") -> DataFrame:
    g, act = F.coalesce(regime, F.lit("NEUTRAL")), F.col("action")
    stormy = g == "HIGH_VOLATILITY"
    agrees = ((g == "BULLISH") & (act == "BUY")) | ((g == "BEARISH") & (act == "SELL"))
    return df.withColumns(
        {
            "predicted_volatility": F.when(stormy, F.col("predicted_volatility") * 1.3).otherwise(F.col("predicted_volatility")),
            "risk_level": F.when(stormy, F.lit("HIGH")).otherwise(F.col("risk_level")),
            "confidence": F.when(agrees, F.least(F.lit(0.95), F.col("confidence") * 1.1)).otherwise(F.col("confidence")),
        }
    )


def position_size(capital: Column, confidence: Column, risk_level: Column) -> Column:
    raw = capital * _lookup(risk_level, BASE_RISK, 0.022) * F.least(confidence, F.lit(1.0)) * _lookup(risk_level, VOL_FACTOR, 0.9)
    return F.greatest(capital * 0.008, F.least(raw, capital * 0.07))


def enhanced_position_size(capital: Column, confidence: Column, risk_level: Column, regime: Column, sentiment: Column) -> Column:
    base = _lookup(risk_level, ENHANCED_RISK, 0.020) * _lookup(regime, REGIME_FACTOR, 1.0) * (1 + F.coalesce(sentiment, F.lit(0.0)) * 0.3)
    return F.greatest(capital * 0.005, F.least(capital * base * F.least(confidence, F.lit(1.0)), capital * 0.05))


def pre_trade_checks(
    df: DataFrame, keys, day: str, order, capital: Column, max_trades: int = 10, max_share: float = 0.1, daily_loss: float = 0.03, regime: str | None = None
) -> DataFrame:
    """Cap sizes and mark why a trade would be refused. Needs position_size, price, confidence,
    risk_level, and daily_pnl (profit and loss of the day before the trade, 0 when unknown).

    A portfolio trades at most ``max_trades`` times a day, so its orders of one day are few.
    """
    cap_size = capital * max_share
    over = F.col("position_size") > cap_size
    quantity = F.greatest(F.floor(F.least(F.col("position_size"), cap_size) / F.col("price")), F.when(over, 1).otherwise(0)).cast("long")
    veto = (F.col(regime) == "HIGH_VOLATILITY") & (F.col("risk_level") == "HIGH") if regime else F.lit(False)
    base = df.withColumns({"quantity": quantity, "__ok": ~((F.col("confidence") < 0.25) | veto | (F.col("daily_pnl") < -capital * daily_loss))})
    w = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col("__ok").cast("int")).over(w)
    return base.withColumn(
        "refusal",
        F.when(F.col("confidence") < 0.25, "low confidence").when(F.col("daily_pnl") < -capital * daily_loss, "daily loss limit").when(veto, "high volatility")
        .when(n > max_trades, "daily trade limit"),
    ).drop("__ok")
