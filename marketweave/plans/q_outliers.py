"""Queries for outlier detection and treatment, anomaly detectors, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions.num import r
from marketweave.operators import anomalies as an
from marketweave.operators import neighbours as nb
from marketweave.operators import outliers as ol
from marketweave.operators import scaling as scl
from marketweave.plans.registry import query
from marketweave.plans.roles import table
from marketweave.session import cut, spread

COLS = ("l_quantity", "l_extendedprice")
PK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_PK = ", ".join(PK)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*PK, *COLS)


def _q(c: str, *ps: float) -> str:
    return ", ".join(f"quantile_cont({c}, {p}) AS {c}_q{int(p * 100)}" for p in ps)


_LINE_STATS = "s AS (SELECT " + ", ".join(f"{_q(c, 0.05, 0.25, 0.5, 0.75, 0.95)}, avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_sd, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in COLS) + " FROM lineitem)"
_EV_STATS = f"s AS (SELECT {_q('value', 0.05, 0.25, 0.5, 0.75, 0.95)}, avg(value) AS m, stddev_samp(value) AS sd, stddev_pop(value) AS sp, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events)"
_OUT = "(value < value_q25 - 1.5 * (value_q75 - value_q25) OR value > value_q75 + 1.5 * (value_q75 - value_q25))"


@query(
    "outlier_flags_quartiles",
    f"WITH {_LINE_STATS} SELECT {_PK}, " + ", ".join(
        f"CAST({c} < {c}_q25 - 1.5 * ({c}_q75 - {c}_q25) OR {c} > {c}_q75 + 1.5 * ({c}_q75 - {c}_q25) AS INT) AS {c}_outlier_iqr" for c in COLS) + " FROM lineitem, s",
)
def outlier_flags_quartiles(spark, sf):
    return ol.flag_iqr(_lines(spark, sf), COLS).drop(*COLS)


@query("outlier_flags_zscore", f"WITH {_EV_STATS} SELECT event_id, CAST(abs((value - m) / sd) > 3 AS INT) AS value_outlier_zscore FROM events, s")
def outlier_flags_zscore(spark, sf):
    return ol.flag_zscore(_events(spark, sf), ["value"]).drop("value")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


@query(
    "outlier_flags_mad",
    f"WITH {_EV_STATS}, d AS (SELECT median(abs(value - value_q50)) AS mad FROM events, s) SELECT event_id, CAST(0.6745 * abs(value - value_q50) / mad > 3 AS INT) AS value_outlier_mad FROM events, s, d",
)
def outlier_flags_mad(spark, sf):
    return ol.flag_mad(_events(spark, sf), ["value"]).drop("value")


def _sql_summary(c: str, x: str) -> str:
    """Rules in words of the inventory: the density is a kernel sum over all rows, without classes."""
    return f"""SELECT * FROM (WITH t AS (SELECT CAST({x} AS DOUBLE) AS x FROM events),
      s AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi, count(x) AS n, skewness(x) AS sk, kurtosis(x) AS ku FROM t),
      o AS (SELECT count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o, count(*) FILTER (abs(x - m) > 3 * sd) AS far FROM t, s),
      d AS (SELECT i, sum(exp(-0.5 * pow((lo + (hi - lo) * i / 99 - x) / (sd * pow(n, -0.2)), 2))) AS d FROM t, s, range(100) g(i) GROUP BY i),
      p AS (SELECT count(*) AS peaks FROM (SELECT d, lag(d) OVER (ORDER BY i) AS a, lead(d) OVER (ORDER BY i) AS b FROM d) WHERE d > a AND d > b)
    SELECT '{c}' AS "column", o AS outliers, round(100.0 * o / n, 6) AS outlier_pct, CASE WHEN o = 0 THEN 'none' WHEN 100.0 * o / n > 10 THEN 'high' WHEN 100.0 * o / n > 5 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN abs(sk) > 3 THEN 'skewness' WHEN ku > 5 THEN 'heavy_tailed' WHEN peaks > 2 THEN 'multimodal' WHEN far > 0 THEN 'point' ELSE 'general' END AS kind, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis
    FROM s, o, p)"""


# the values, and columns made from them that meet the other rules
_SHAPES = {"value": "value", "logarithm": "ln(value + 1)", "three_modes": "10 * (event_id % 3) + ln(value + 1) / 10", "fourth_power": "value * value * value * value"}


@query("outlier_column_summary", " UNION ALL ".join(_sql_summary(c, x) for c, x in _SHAPES.items()))
def outlier_column_summary(spark, sf):
    shapes = table(spark, sf, "events").selectExpr(*[f"CAST({x} AS DOUBLE) AS {c}" for c, x in _SHAPES.items()])
    out = ol.describe_outliers(shapes, list(_SHAPES))
    return out.select("column", "outliers", r("outlier_pct").alias("outlier_pct"), "severity", "kind", r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


@query("outlier_auto_detection")
def outlier_auto_detection(spark, sf):
    """The whole plan over four columns: three single-column methods, the forest and local density."""
    cols = [*COLS, "l_discount", "l_tax"]
    df = table(spark, sf, "lineitem").select(*PK, *cols)
    return ol.detect(df, ol.detection_plan(df, cols), PK).drop(*cols)


@query("capped_by_quantiles", f"WITH {_EV_STATS} SELECT event_id, round(least(greatest(value, value_q5), value_q95), 9) AS value FROM events, s")
def capped_by_quantiles(spark, sf):
    return ol.cap(_events(spark, sf), ["value"]).withColumn("value", r("value", 9))


@query(
    "capped_by_quartiles",
    f"""WITH {_EV_STATS}, b AS (SELECT CASE WHEN lo >= 0 AND l2 < 0 THEN 0 ELSE l2 END AS l, h FROM (SELECT lo, CASE WHEN lo > 0 AND l1 < lo * 0.1 THEN greatest(l1, lo * 0.5) ELSE l1 END AS l2, h
       FROM (SELECT lo, value_q25 - 2 * (value_q75 - value_q25) AS l1, value_q75 + 2 * (value_q75 - value_q25) AS h FROM s)))
    SELECT event_id, round(least(greatest(value, l), h), 9) AS value FROM events, b""",
)
def capped_by_quartiles(spark, sf):
    return ol.cap(_events(spark, sf), ["value"], "iqr").withColumn("value", r("value", 9))


@query(
    "winsorised_values",
    """WITH x AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events),
    b AS (SELECT max(value) FILTER (k = floor(0.05 * n)) AS l, max(value) FILTER (k = n - 1 - floor(0.05 * n)) AS h FROM x)
    SELECT event_id, round(least(greatest(value, l), h), 6) AS value FROM events, b""",
)
def winsorised_values(spark, sf):
    return ol.winsorize(_events(spark, sf), ["value"]).withColumn("value", r("value"))


@query(
    "compressed_values",
    f"WITH {_EV_STATS} SELECT event_id, round(ln(value + CASE WHEN lo > 0 THEN 0 ELSE abs(lo) + 1 END), 6) AS value_log, round(sqrt(value), 6) AS value_sqrt FROM events, s",
)
def compressed_values(spark, sf):
    df = _events(spark, sf).select("event_id", F.col("value").alias("value_log"), F.col("value").alias("value_sqrt"))
    out = ol.compress(ol.compress(df, ["value_log"], "log"), ["value_sqrt"], "sqrt")
    return out.select("event_id", r("value_log").alias("value_log"), r("value_sqrt").alias("value_sqrt"))


@query("imputed_outliers", f"WITH {_EV_STATS} SELECT event_id, CASE WHEN {_OUT} THEN value_q50 ELSE value END AS value FROM events, s")
def imputed_outliers(spark, sf):
    return ol.replace_outliers(_events(spark, sf), ["value"])


@query(
    "removed_outliers",
    f"""WITH {_EV_STATS}, x AS (SELECT count(*) FILTER ({_OUT}) / count(*) AS share FROM events, s), k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events),
    b AS (SELECT max(value) FILTER (k = floor(0.05 * n)) AS l, max(value) FILTER (k = n - 1 - floor(0.05 * n)) AS h FROM k)
    SELECT event_id, round(CASE WHEN share > 0.05 THEN least(greatest(value, l), h) WHEN NOT {_OUT} THEN value END, 6) AS value FROM events, s, x, b""",
)
def removed_outliers(spark, sf):
    return ol.null_outliers(_events(spark, sf), ["value"]).withColumn("value", r("value"))


@query("outlier_auto_treatment")
def outlier_auto_treatment(spark, sf):
    cols = [*COLS, "o_totalprice"]
    # joined once: the statistics of each step read what is written here
    df = cut(_lines(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey").select(*PK, *cols))
    described = ol.describe_outliers(df, cols)
    treated = cut(ol.treat(df, ol.treatment_plan(described)))
    return ol.effectiveness(df, treated, cols, described)


# -- anomaly detectors ------------------------------------------------------------------------


def _points(spark, sf, dims: int = 2):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)])


@query("isolation_forest_flags")
def isolation_forest_flags(spark, sf):
    out = an.isolation_forest(spread(_lines(spark, sf), *PK).withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity")), [*COLS, "unit"], PK)
    return out.select(*PK, r("anomaly_score").alias("anomaly_score"), "outlier_isolation_forest")


_PTS = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings)"


@query(
    "elliptic_envelope_flags",
    f"""WITH {_PTS}, m AS (SELECT avg(x0) AS a, avg(x1) AS b, var_pop(x0) AS s, var_pop(x1) AS t, covar_pop(x0, x1) AS c FROM p),
    d AS (SELECT vec_id, ((x0 - a) * (x0 - a) * t - 2 * (x0 - a) * (x1 - b) * c + (x1 - b) * (x1 - b) * s) / (s * t - c * c) AS d2 FROM p, m), q AS (SELECT quantile_cont(d2, 0.9) AS q FROM d)
    SELECT vec_id, round(d2, 6) AS mahalanobis, CAST(d2 > q AS INT) AS outlier_elliptic_envelope FROM d, q""",
)
def elliptic_envelope_flags(spark, sf):
    out = an.elliptic_envelope(_points(spark, sf), ["x0", "x1"], 0.1, steps=0)
    return out.select("vec_id", r("mahalanobis").alias("mahalanobis"), "outlier_elliptic_envelope")


@query("robust_envelope_flags")
def robust_envelope_flags(spark, sf):
    out = an.elliptic_envelope(_points(spark, sf, 3), ["x0", "x1", "x2"], 0.1)
    return out.select("vec_id", r("mahalanobis").alias("mahalanobis"), "outlier_elliptic_envelope")


@query(
    "density_noise_flags",
    f"""WITH {_PTS}, near AS (SELECT a.vec_id AS q, b.vec_id AS p FROM p a, p b WHERE (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= 0.0004),
    core AS (SELECT q FROM near GROUP BY q HAVING count(*) >= 5), ok AS (SELECT DISTINCT n.q FROM near n JOIN core c ON n.p = c.q)
    SELECT vec_id, CAST(vec_id NOT IN (SELECT q FROM ok) AS INT) AS outlier_dbscan FROM p""",
)
def density_noise_flags(spark, sf):
    return an.dbscan_noise(_points(spark, sf), ["x0", "x1"], ["vec_id"], eps=0.02, min_points=5).select("vec_id", "outlier_dbscan")


@query(
    "local_outlier_factors",
    f"""WITH {_PTS}, d AS (SELECT a.vec_id AS q, b.vec_id AS p, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS dist FROM p a, p b WHERE a.vec_id <> b.vec_id),
    nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, p) AS rk FROM d) WHERE rk <= 20), kd AS (SELECT q, max(dist) AS k FROM nn GROUP BY q),
    l AS (SELECT nn.q, 1.0 / (avg(greatest(kd.k, nn.dist)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.p = kd.q GROUP BY nn.q)
    SELECT nn.q AS vec_id, round(avg(b.lrd) / any_value(a.lrd), 5) AS lof, CAST(avg(b.lrd) / any_value(a.lrd) > 1.5 AS INT) AS outlier_lof FROM nn JOIN l a ON nn.q = a.q JOIN l b ON nn.p = b.q GROUP BY nn.q""",
)
def local_outlier_factors(spark, sf):
    out = nb.local_outlier_factor(_points(spark, sf), ["x0", "x1"], ["vec_id"], k=20)
    return out.select("vec_id", r("lof", 5).alias("lof"), "outlier_lof")


# -- scaling ----------------------------------------------------------------------------------


@query(
    "linear_scalers",
    f"""WITH {_EV_STATS} SELECT event_id, round((value - m) / sp, 6) AS standard, round((value - lo) / (hi - lo), 6) AS minmax, round((value - value_q50) / (value_q75 - value_q25), 6) AS robust,
      round(value / greatest(abs(lo), abs(hi)), 6) AS maxabs FROM events, s""",
)
def linear_scalers(spark, sf):
    names = ("standard", "minmax", "robust", "maxabs")
    df = _events(spark, sf).select("event_id", *[F.col("value").alias(k) for k in names])
    out = scl.transform(df, scl.fit(df, {k: k for k in names}))
    return out.select("event_id", *[r(f"{k}_scaled").alias(k) for k in names])


@query(
    "quantile_scaler",
    """WITH q AS (SELECT quantile_cont(value, [i / 100.0 for i in range(0, 101)]) AS g FROM events),
    x AS (SELECT event_id, value, g, greatest(least(len(list_filter(g, lambda v: v <= value)), 100), 1) AS k FROM events, q)
    SELECT event_id, round(CASE WHEN value <= g[1] THEN 0 WHEN value >= g[101] THEN 1 WHEN g[k + 1] > g[k] THEN (k - 1) / 100.0 + (value - g[k]) / (g[k + 1] - g[k]) / 100.0 ELSE k / 100.0 END, 6) AS value_scaled FROM x""",
)
def quantile_scaler(spark, sf):
    df = _events(spark, sf)
    return scl.transform(df, scl.fit(df, {"value": "quantile"})).select("event_id", r("value_scaled").alias("value_scaled"))


@query("power_scaler")
def power_scaler(spark, sf):
    df = _events(spark, sf)
    return scl.transform(df, scl.fit(df, {"value": "power"})).select("event_id", r("value_scaled").alias("value_scaled"))


@query("scaler_inversion_accuracy")
def scaler_inversion_accuracy(spark, sf):
    """Every kind there and back, the quantile scaler also with normal scores."""
    kinds = [*scl.KINDS, "quantile_normal"]
    df = _events(spark, sf).select("event_id", *[F.col("value").alias(k) for k in kinds])
    p = scl.fit(df, {k: k for k in scl.KINDS}) | scl.fit(df, {"quantile_normal": "quantile"}, output="normal")
    return scl.inversion_accuracy(scl.invert(scl.transform(df, p), p), kinds)


@query(
    "normal_scores",
    """WITH q AS (SELECT quantile_cont(value, [i / 100.0 for i in range(0, 101)]) AS g FROM events),
    x AS (SELECT event_id, value, g, greatest(least(len(list_filter(g, lambda v: v <= value)), 100), 1) AS k FROM events, q),
    u AS (SELECT event_id, value, CASE WHEN value <= g[1] THEN 0 WHEN value >= g[101] THEN 1 WHEN g[k + 1] > g[k] THEN (k - 1) / 100.0 + (value - g[k]) / (g[k + 1] - g[k]) / 100.0 ELSE k / 100.0 END AS u FROM x)
    SELECT event_id, round(u + 3.3e-8, 6) AS probability, round(value, 5) AS restored FROM u""",
)
def normal_scores(spark, sf):
    """Normal scores of the quantiles: their probabilities and the values restored from them."""
    df = _events(spark, sf)
    p = scl.fit(df, {"value": "quantile"}, output="normal")
    out = scl.invert(scl.transform(df, p), p)
    u = scl.normal_cdf(F.col("value_scaled"))
    return out.select("event_id", r(u + 3.3e-8, 6).alias("probability"), r("value_restored", 5).alias("restored"))


@query("recommended_scaling")
def recommended_scaling(spark, sf):
    df = table(spark, sf, "lineitem").select(*PK, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    plan = scl.recommend(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return scl.transform(df, scl.fit(df, plan))


# a column for each rule, made from the lines
_RULED = {
    "two_values": "CASE WHEN l_tax > 0.04 THEN 900 ELSE 0 END", "percentage": "l_quantity", "skewed": "l_extendedprice * l_extendedprice * l_extendedprice * l_extendedprice * l_discount * l_discount * l_discount",
    "far_values": "CASE WHEN l_linenumber = 7 THEN 200 + l_quantity * 20 WHEN l_linenumber = 6 THEN -800 ELSE l_quantity + 150 END", "negative": "l_extendedprice - 40000", "bell": "l_quantity + l_discount * 500 + l_tax * 500 + 50",
}


def _sql_scaler(c: str, x: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN kinds = 2 THEN 'minmax' WHEN lo >= 0 AND hi <= 100 THEN 'minmax' WHEN abs(sk) > 2 THEN 'power' WHEN o / n > 0.05 THEN 'robust' WHEN lo < 0 THEN 'standard'
      WHEN zeros / n > 0.8 THEN 'maxabs' WHEN abs(sk) < 1 AND abs(ku) < 3 THEN 'standard' ELSE 'robust' END AS scaler
    FROM (SELECT count(DISTINCT x) AS kinds, min(x) AS lo, max(x) AS hi, skewness(x) AS sk, kurtosis(x) AS ku, count(x) AS n, count(*) FILTER (x = 0) AS zeros,
        count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o
      FROM (SELECT x, q1, q3 FROM (SELECT CAST({x} AS DOUBLE) AS x FROM lineitem), (SELECT quantile_cont(CAST({x} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({x} AS DOUBLE), 0.75) AS q3 FROM lineitem)))"""


@query("scaler_choices", " UNION ALL ".join(_sql_scaler(c, x) for c, x in _RULED.items()))
def scaler_choices(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"CAST({x} AS DOUBLE) AS {c}" for c, x in _RULED.items()])
    return spark.createDataFrame(list(scl.recommend(df, list(_RULED)).items()), "column string, scaler string")


# a column for each rule of whether to scale at all
_NEEDS = {
    "order_id": "l_orderkey", "share": "l_discount", "standard": "(l_quantity - 25.5) / 14.43", "fixed": "7", "sign": "CASE WHEN l_tax > 0.01 THEN 1 ELSE -1 END",
    "price": "l_extendedprice", "steep": "CASE WHEN l_quantity = 50 THEN 90 ELSE l_tax END", "quantity": "l_quantity",
}


def _sql_need(c: str, x: str) -> str:
    named = " OR ".join(f"contains('{c}', '{part}')" for part in ("id", "index", "count", "flag", "binary", "dummy", "encoded", "year", "month", "day", "week", "quarter", "season"))
    return f"""SELECT '{c}' AS "column", CAST(reason IN ('wide range', 'skewed', 'numeric') AS INT) AS needs_scaling, reason FROM (SELECT CASE WHEN {named} THEN 'name' WHEN lo >= 0 AND hi <= 1 THEN 'unit range'
      WHEN abs(m) < 0.1 AND sd > 0.9 AND sd < 1.1 THEN 'standardised' WHEN kinds = 1 THEN 'constant' WHEN kinds = 2 AND lo = -1 AND hi = 1 THEN 'two values' WHEN hi - lo > 1000 OR sd > 100 THEN 'wide range'
      WHEN abs(sk) > 2 THEN 'skewed' ELSE 'numeric' END AS reason
      FROM (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_samp(x) AS sd, skewness(x) AS sk, count(DISTINCT x) AS kinds FROM (SELECT CAST({x} AS DOUBLE) AS x FROM lineitem)))"""


@query("columns_to_scale", " UNION ALL ".join(_sql_need(c, x) for c, x in _NEEDS.items()))
def columns_to_scale(spark, sf):
    return scl.scaling_needs(table(spark, sf, "lineitem").selectExpr(*[f"CAST({x} AS DOUBLE) AS {c}" for c, x in _NEEDS.items()]))
