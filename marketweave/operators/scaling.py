"""Reversible scaling. ``fit`` gives a small parameter list; transform and invert are columns."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.num import bound, nan_to_null, numeric_columns
from marketweave.functions.scalar import inverse_yeo_johnson, yeo_johnson
from marketweave.operators.outliers import column_stats
from marketweave.operators.quantiles import exact_quantiles

KINDS = ("standard", "minmax", "robust", "maxabs", "power", "quantile")


def fit(df: DataFrame, plan: dict[str, str], quantiles: int = 100, output: str = "uniform") -> dict[str, dict]:
    """Column -> {kind, ...}. Fit on the training rows only and reuse everywhere."""
    cols = list(plan)
    st = column_stats(df, cols)
    params: dict[str, dict] = {}
    power = [c for c in cols if plan[c] == "power"]
    lambdas = fit_yeo_johnson(df, power) if power else {}
    ranks = [c for c in cols if plan[c] == "quantile"]
    grid = exact_quantiles(df, ranks, [i / quantiles for i in range(quantiles + 1)]) if ranks else {}
    spread = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    for c, kind in plan.items():
        s = st[c]
        p: dict = {"kind": kind}
        if s is None:
            p.update(kind="none")
        elif kind == "standard":
            p.update(shift=s.mean, scale=spread[c] or 1.0)
        elif kind == "minmax":
            p.update(shift=s.low, scale=(s.high - s.low) or 1.0)
        elif kind == "robust":
            p.update(shift=s.median, scale=s.iqr or 1.0)
        elif kind == "maxabs":
            p.update(shift=0.0, scale=max(abs(s.low), abs(s.high)) or 1.0)
        elif kind == "power":
            p.update(lambdas[c])
        elif kind == "quantile":
            p.update(grid=grid[c], output=output)
        params[c] = p
    return params


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], rounds: int = 3) -> dict[str, dict]:
    """Exponent with the largest likelihood on a grid that is refined around the best point.
    The likelihood needs only sums, so each round is one aggregate for all columns."""
    centre = {c: (0.0, 2.0) for c in cols}
    best: dict[str, dict] = {}
    for _ in range(rounds):
        trial = {c: [round(m + w * i / 8, 6) for i in range(-8, 9)] for c, (m, w) in centre.items()}
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs.append(F.struct(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j")).alias(f"{c}_base"))
            for i, lam in enumerate(trial[c]):
                y = yeo_johnson(x, lam)
                aggs.append(F.struct(F.var_pop(y).alias("v"), F.avg(y).alias("m")).alias(f"{c}_{i}"))
        row = df.agg(*aggs).first()
        for c in cols:
            n, j = row[f"{c}_base"]["n"], row[f"{c}_base"]["j"]
            scored = []
            for i, lam in enumerate(trial[c]):
                v = row[f"{c}_{i}"]["v"]
                if n and v and v > 0:
                    scored.append((-0.5 * n * math.log(v) + (lam - 1) * j, -i, lam, row[f"{c}_{i}"]["m"], math.sqrt(v)))
            if scored:
                _, _, lam, mean, sd = max(scored)
                best[c] = {"lambda": lam, "shift": mean, "scale": sd}
                centre[c] = (lam, centre[c][1] / 8)
            else:
                best[c] = {"lambda": 1.0, "shift": 0.0, "scale": 1.0}
    return best


#: Normal scores are limited to those of this probability and its complement.
EDGE = 1e-7


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def _ppf(p: Column) -> Column:
    """Inverse normal distribution by rational approximation (published by P. Acklam), refined once."""
    # Coefficients of the approximation.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def middle(p: Column) -> Column:
        q = p - 0.5
        return bound(q * q, lambda s: _poly(a, s) / _poly(b, s)) * q

    def tail(p: Column) -> Column:
        return bound(F.sqrt(-2 * F.ln(p)), lambda t: _poly(c, t) / _poly(d, t))

    def refined(p: Column, z: Column) -> Column:
        """One step of Halley's method on the distribution function."""
        return bound((normal_cdf(z) - p) * math.sqrt(2 * math.pi) * F.exp(z * z / 2), lambda u: z - u / (1 + z * u / 2))

    def rough(p: Column) -> Column:
        return F.when(p < 0.02425, tail(p)).when(p > 0.97575, -tail(1 - p)).otherwise(middle(p))

    return bound(p, lambda p: bound(rough(p), lambda z: refined(p, z)))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by rational approximation (published by J. F. Hart), for
    |z| < 7 within 1e-14; beyond, 0 or 1."""
    # Coefficients of the approximation, highest power first.
    top = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    bottom = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

    def tail(x: Column) -> Column:
        return F.when(x < 7, F.exp(-x * x / 2) * _poly(top, x) / _poly(bottom, x)).otherwise(0.0)

    def both(z: Column) -> Column:
        return F.when(z > 0, 1 - bound(F.abs(z), tail)).when(z <= 0, bound(F.abs(z), tail))

    return bound(z, both)


def _interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through sorted points: the position is found by counting smaller points
    in a literal array, so the expression stays small."""
    px, py = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])

    def inside(x: Column) -> Column:
        at = F.aggregate(px, F.lit(0), lambda acc, v: acc + F.when(v <= x, 1).otherwise(0))

        def between(lo: Column) -> Column:
            x0, x1, y0, y1 = px[lo - 1], px[lo], py[lo - 1], py[lo]
            return F.when(x1 > x0, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(y1)

        return F.when(x <= xs[0], float(ys[0])).when(x >= xs[-1], float(ys[-1])).when(x.isNotNull(), bound(F.greatest(F.least(at, F.lit(len(xs) - 1)), F.lit(1)), between))

    return bound(x, inside)


def scaled(c: Column, p: dict) -> Column:
    x = c.cast("double")
    if p["kind"] == "none":
        return x
    if p["kind"] == "quantile":
        n = len(p["grid"]) - 1
        u = _interpolate(x, p["grid"], [i / n for i in range(n + 1)])
        return bound(u, lambda u: F.when(u.isNotNull(), _ppf(F.greatest(F.least(u, F.lit(1 - EDGE)), F.lit(EDGE))))) if p["output"] == "normal" else u
    if p["kind"] == "power":
        x = yeo_johnson(x, p["lambda"])
    return (x - p["shift"]) / p["scale"]


def inverted(c: Column, p: dict) -> Column:
    if p["kind"] == "none":
        return c
    if p["kind"] == "quantile":
        n = len(p["grid"]) - 1
        if p["output"] == "normal":
            # the limited ends are the smallest and largest values of the grid
            c = bound(normal_cdf(c), lambda u: F.when(u <= EDGE * (1 + 1e-3), 0.0).when(u >= 1 - EDGE * (1 + 1e-3), 1.0).otherwise(u))
        return _interpolate(c, [i / n for i in range(n + 1)], p["grid"])
    x = c * p["scale"] + p["shift"]
    return inverse_yeo_johnson(x, p["lambda"]) if p["kind"] == "power" else x


def transform(df: DataFrame, params: dict[str, dict], suffix: str = "_scaled") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": scaled(F.col(c), p) for c, p in params.items()})


def invert(df: DataFrame, params: dict[str, dict], suffix: str = "_scaled", out: str = "_restored") -> DataFrame:
    return df.withColumns({f"{c}{out}": inverted(F.col(f"{c}{suffix}"), p) for c, p in params.items()})


def inversion_accuracy(df: DataFrame, cols: Sequence[str], out: str = "_restored", tolerance: float = 1e-6) -> DataFrame:
    rows = []
    for c in cols:
        e = F.abs(F.col(c) - F.col(f"{c}{out}"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.avg(e).alias("mae"), F.max(e).alias("max_error"), F.sqrt(F.avg(e * e)).alias("rmse"),
                (F.avg(F.when(e <= tolerance, 100.0).otherwise(0.0))).alias("within_tolerance_pct"), (F.max(e) <= tolerance).cast("int").alias("is_exact"),
            )
        )
    return df.agg(F.array(*rows).alias("__m")).select(F.inline("__m"))


# -- rules ------------------------------------------------------------------------------------

# Parts of names that are never scaled.
EXCLUDED_NAME_PARTS = (
    "id", "index", "count", "flag", "binary", "dummy", "encoded", "year", "month", "day", "week", "quarter", "season",
)


def recommend(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Scaler per column: the first rule that its statistics meet."""
    st = column_stats(df, cols)
    usable = [c for c in cols if st[c] is not None]
    row = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c) == 0).alias("zeros"),
                F.count_if((F.col(c) < st[c].q1 - 1.5 * st[c].iqr) | (F.col(c) > st[c].q3 + 1.5 * st[c].iqr)).alias("out"),
                F.count_if((F.col(c) != st[c].low) & (F.col(c) != st[c].high)).alias("between"),
            ).alias(c)
            for c in usable
        ]
    ).first()
    plan = {}
    for c in usable:
        s, m = st[c], row[c]
        rules = (
            ("minmax", m["between"] == 0 and s.low < s.high),
            ("minmax", s.low >= 0 and s.high <= 100),
            ("power", abs(s.skew) > 2),
            ("robust", m["out"] / s.n > 0.05),
            ("standard", s.low < 0),
            ("maxabs", m["zeros"] / s.n > 0.8),
            ("standard", abs(s.skew) < 1 and abs(s.kurt) < 3),
            ("robust", True),
        )
        plan[c] = next(name for name, holds in rules if holds)
    return plan


def scaling_needs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, needs_scaling, reason) per numeric column: the first rule that holds gives the reason."""
    cols = list(cols or numeric_columns(df))
    rows = []
    stats = column_stats(df, cols)
    usable = [c for c in cols if stats[c] is not None]
    inner = df.agg(*[F.count_if((nan_to_null(c) != stats[c].low) & (nan_to_null(c) != stats[c].high)).alias(c) for c in usable]).first() if usable else None
    for c in usable:
        s = stats[c]
        rules = (
            ("name", 0, any(part in c.lower() for part in EXCLUDED_NAME_PARTS)),
            ("unit range", 0, s.low >= 0 and s.high <= 1),
            ("standardised", 0, abs(s.mean) < 0.1 and 0.9 < s.std < 1.1),
            ("constant", 0, s.low == s.high),
            ("two values", 0, inner[c] == 0 and (s.low, s.high) == (-1, 1)),
            ("wide range", 1, s.high - s.low > 1000 or s.std > 100),
            ("skewed", 1, abs(s.skew) > 2),
            ("numeric", 1, True),
        )
        rows.append((c, *next((need, reason) for reason, need, holds in rules if holds)))
    return df.sparkSession.createDataFrame(rows, "column string, needs_scaling int, reason string")


def save_params(df_session, params: dict[str, dict], path: str) -> None:
    rows = [(c, json.dumps(p)) for c, p in params.items()]
    df_session.createDataFrame(rows, "column string, params string").coalesce(1).write.mode("overwrite").parquet(path)


def load_params(df_session, path: str) -> dict[str, dict]:
    return {r["column"]: json.loads(r["params"]) for r in df_session.read.parquet(path).collect()}  # one row per column
