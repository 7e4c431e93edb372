"""Reading CSV, Parquet and JSON feeds, scanning folders, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """UTF-8, or Latin-1 when some line does not decode. Without a schema every column is a
    string, to be typed afterwards; the data are not scanned to guess types."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    encoding = "ISO-8859-1" if broken.take(1) else "UTF-8"
    reader = spark.read.option("header", header).option("encoding", encoding).option("multiLine", False).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return read_csv(spark, path, schema) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def scan_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, path, kind, bytes) of every CSV and Parquet file below a folder. Only names and
    sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    parent, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    return files.withColumn("kind", kind).filter(F.col("kind").isin("csv", "parquet")).select(
        F.concat_ws("_", parent, stem).alias("dataset"), "path", "kind", F.col("length").alias("bytes")
    )


def inspect(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows only, for looking at a source."""
    return df.limit(rows)


def save_data(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer.option("header", True).csv(path)
    elif file_format == "json":
        writer.json(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {file_format}")


def save_report(metrics: DataFrame, path: str, dataset: str) -> None:
    """Long-form metrics of one dataset; a rerun replaces only that dataset."""
    metrics.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").json(f"{path.rstrip('/')}/dataset={dataset}")


FEED = (
    "feed array<struct<title:string, url:string, time_published:string, authors:array<string>, summary:string, source:string, "
    "overall_sentiment_score:double, ticker_sentiment:array<struct<ticker:string, ticker_sentiment_score:string>>>>"
)
ARTICLES = (
    "articles array<struct<source:struct<id:string, name:string>, author:string, title:string, description:string, url:string, publishedAt:string, content:string>>"
)


def sentiment_feed(raw: DataFrame, c: str = "value") -> DataFrame:
    """One row per article of a nested feed, with a map ticker -> score in place of columns per ticker."""
    a = raw.select(F.explode(F.from_json(F.col(c), FEED)["feed"]).alias("a"))
    pairs = F.transform("a.ticker_sentiment", lambda t: F.struct(t["ticker"], t["ticker_sentiment_score"].try_cast("double")))
    seen = F.filter(pairs, lambda p: p["ticker"].isNotNull())
    return a.select(
        "a.source", "a.title", "a.summary", "a.url", "a.authors", F.col("a.time_published").alias("published_at"),
        F.col("a.overall_sentiment_score").alias("overall_sentiment"), F.transform("a.ticker_sentiment", lambda t: t["ticker"]).alias("tickers"),
        F.map_from_entries(seen).alias("ticker_sentiment"),
    )


def article_pages(raw: DataFrame, c: str = "value") -> DataFrame:
    a = raw.select("*", F.explode(F.from_json(F.col(c), ARTICLES)["articles"]).alias("a"))
    keep = [x for x in ("query", "page") if x in raw.columns]
    return a.select(
        F.col("a.source.name").alias("source"), "a.author", "a.title", "a.description", "a.content", "a.url", F.col("a.publishedAt").alias("published_at"), *keep
    )


def collection_summary(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("source"), "records")
        out = row if out is None else out.unionByName(row)
    return out
