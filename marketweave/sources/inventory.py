"""Row counts, columns and missing cells of many Parquet tables, from their footers where possible.

Counts of rows and of non-null values stand in the footers: the aggregate is pushed into the scan,
whose tasks read only the ends of the files. Data are read only for columns whose missing values a
footer does not tell (floating-point columns, where NaN is missing as well, and nested ones), for
columns with gaps when the complete rows have to be counted over several of them, and for tables
whose files carry no statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.functions.num import numeric_columns
from marketweave.operators.profile import datetime_columns, missing_rows, string_columns

SCHEMA = (
    "dataset string, rows long, columns int, numeric_columns int, string_columns int, datetime_columns int, cells long, missing_cells long, "
    "missing_pct double, complete_rows long, scanned_columns int"
)


@contextmanager
def _pushed_aggregates(spark: SparkSession) -> Iterator[None]:
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def told_by_footers(schema: T.StructType) -> list[str]:
    """Columns whose missing values are exactly the nulls that a footer counts."""
    unclear = (T.DoubleType, T.FloatType, T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)
    return [f.name for f in schema.fields if not isinstance(f.dataType, unclear)]


def footer_counts(spark: SparkSession, path: str, cols: list[str]) -> dict[str, int] | None:
    """Rows (under "") and non-null values per column without reading data; None without statistics."""
    with _pushed_aggregates(spark):
        try:
            counted = spark.read.parquet(path).agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in cols])
            return {c: n or 0 for c, n in zip(["", *cols], counted.first(), strict=True)}  # no files: no sum
        except (PySparkException, Py4JJavaError) as e:
            if "aggregatePushdown" not in str(e):  # the reader's word for missing statistics
                raise
            return None


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per table: rows, columns by kind, cells, missing cells, complete rows, and how many of
    its columns had to be read."""
    out = []
    for name, path in paths.items():
        df = spark.read.parquet(path)
        clear = told_by_footers(df.schema)
        known = footer_counts(spark, path, clear)
        if known is None:
            read = df.columns
        else:
            gaps = [c for c in clear if known[c] < known[""]]
            unclear = [c for c in df.columns if c not in clear]
            read = unclear + gaps if unclear or len(gaps) > 1 else []
        if read:
            m = missing_rows(df.select(*[F.col(f"`{c}`") for c in read])).first()
            rows, missing, complete = m["rows"], m["missing_cells"], m["complete_rows"]
        else:
            rows = known[""]
            missing = sum(rows - known[c] for c in clear)
            complete = rows - missing  # at most one column has gaps
        cells = rows * len(df.columns)
        kinds = (len(numeric_columns(df)), len(string_columns(df)), len(datetime_columns(df)))
        out.append((name, rows, len(df.columns), *kinds, cells, missing, missing / cells * 100 if cells else None, complete, len(read)))
    return spark.createDataFrame(out, SCHEMA)  # one row per table
