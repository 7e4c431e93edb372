"""How the given tables play the market roles: bars, ticks, news, social posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.operators.axis import Axis
from marketweave.session import dealt, spread

# Bars per key are limited by the calendar, so their windows may run whole.
BAR_AXIS = Axis(keys=("key",), order=("day",), bounded=True)
# Raw events of one user are not limited by anything.
TICK_AXIS = Axis(keys=("user_id",), order=("ts", "event_id"), bounded=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The given tables with their columns, by kind: n number, f floating point, s string, d date-time, o other.
TABLES = {
    "region": "n r_regionkey, s r_name",
    "nation": "n n_nationkey, s n_name, n n_regionkey",
    "customer": "n c_custkey, s c_name, n c_nationkey, f c_acctbal, s c_mktsegment",
    "supplier": "n s_suppkey, s s_name, n s_nationkey, f s_acctbal",
    "part": "n p_partkey, s p_name, s p_brand, s p_type, n p_size, f p_retailprice",
    "orders": "n o_orderkey, n o_custkey, s o_orderstatus, f o_totalprice, d o_orderdate, s o_orderpriority",
    "lineitem": "n l_orderkey, n l_partkey, n l_suppkey, n l_linenumber, f l_quantity, f l_extendedprice, f l_discount, f l_tax, s l_returnflag, s l_linestatus, d l_shipdate",
    "events": "n event_id, d ts, n user_id, s event_type, f value, s props",
    "documents": "n doc_id, s text, s lang, s source, n n_chars",
    "embeddings": "n vec_id, o embedding, n label",
    "pages": "n page_id, s url, s html",
    "benchmark": "n item_id, s text",
    "labels": "n doc_id, n quality, n toxic",
    "conversations": "n conv_id, n turn, s role, s text",
}


def sql_inventory() -> str:
    """The counts of all given tables: every cell is looked at."""
    parts = []
    for name, columns in TABLES.items():
        cols = [c.split() for c in columns.split(", ")]
        gaps = [f"CAST({c} IS NULL{f' OR isnan({c})' if kind == 'f' else ''} AS INT)" for kind, c in cols]
        kinds = [sum(kind in k for kind, _ in cols) for k in ("nf", "s", "d")]
        parts.append(
            f"""SELECT '{name}' AS dataset, count(*) AS rows, {len(cols)} AS "columns", {kinds[0]} AS numeric_columns, {kinds[1]} AS string_columns, {kinds[2]} AS datetime_columns, count(*) * {len(cols)} AS cells,
            CAST(sum({" + ".join(gaps)}) AS BIGINT) AS missing_cells, 100.0 * sum({" + ".join(gaps)}) / (count(*) * {len(cols)}) AS missing_pct, count(*) FILTER ({" + ".join(gaps)} = 0) AS complete_rows FROM {name}"""
        )
    return " UNION ALL ".join(parts)


def table_paths(sf_dir: str) -> dict[str, str]:
    return {name: f"{sf_dir}/{name}.parquet" for name in TABLES}


# Identifiers of the text tables.
TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table over all cores, also when it is one small file: its work is per row and heavy."""
    return spread(table(spark, sf_dir, name), *TEXT_KEYS[name])


def most_bars(spark: SparkSession, sf_dir: str) -> int:
    """There are no more bars than lines; their number stands in the footers."""
    return table(spark, sf_dir, "lineitem").count()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier. The aggregation combines on the map side, so a supplier with a
    third of all lines costs one row per day after the shuffle. Bars of large tables are dealt by
    supplier in tasks of bounded size, which the windows over them keep."""
    lines = table(spark, sf_dir, "lineitem")
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100
    # order of the day's trades as one fixed-width number: a struct would force sort aggregation
    cents = F.round(F.col("price") * 100).cast("decimal(12,0)")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(19,0)")
    rank = line * F.lit(10**12).cast("decimal(13,0)") + cents
    daily = (
        lines.select(
            F.col("l_suppkey").alias("key"),
            F.to_date("l_shipdate").alias("day"),
            "l_orderkey",
            "l_linenumber",
            "l_quantity",
            price.alias("price"),
        )
        .groupBy("key", "day")
        .agg(
            F.min_by("price", rank).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", rank).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
    )
    return dealt(daily, most_bars(spark, sf_dir), "key")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news role: one row per day with a count and a centred pseudo sentiment."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.avg((F.col("o_totalprice") - 250000.0) / 250000.0).alias("news_sentiment"),
    )


# SQL text of the same roles, put in front of the oracle queries.
SQL_BARS = """
bars AS (
  SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day,
         arg_min(price, rank) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, rank) AS close, sum(l_quantity) AS volume, count(*) AS trades
  FROM (SELECT *, {'a': l_orderkey, 'b': l_linenumber, 'c': price} AS rank
        FROM (SELECT *, floor(l_extendedprice * 100 / l_quantity) / 100 AS price FROM lineitem))
  GROUP BY 1, 2
)"""
SQL_NEWS = """
news AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS news_count,
         avg((o_totalprice - 250000.0) / 250000.0) AS news_sentiment
  FROM orders GROUP BY 1
)"""


def sql_full(n: int, fn: str, c: str, part: str = "key", order: str = "day") -> str:
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN {fn}({c}) OVER {w} END"
