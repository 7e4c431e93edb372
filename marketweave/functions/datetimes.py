"""Parsing, time zones and formats of date-time columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions import lexicons as lx


# The signs each part of a format stands for.
_PARTS = (("SSSSSS", r"\\d{1,6}"), ("yyyy", r"\\d{4}"), ("XXX", r"[+-]\\d{2}:\\d{2}"), ("XX", r"(Z|[+-]\\d{4})"), ("'T'", "T"), ("MM|dd|HH|mm|ss", r"\\d{2}"))


def shape_of(fmt: str) -> str:
    """Regular expression of the texts a format can read."""
    out = fmt.replace(".", r"\.")
    for part, signs in _PARTS:
        out = re.sub(part, signs, out)
    return f"^{out}$"


def try_format(c: Column, fmt: str) -> Column:
    """Parse with one format. A failed parse costs an exception, so the shape is tested first."""
    return F.when(c.rlike(shape_of(fmt)), F.try_to_timestamp(c, F.lit(fmt)))


def parse_datetime(c: Column, formats: Sequence[str] = lx.DATETIME_FORMATS) -> Column:
    """First format that fits; null when none does."""
    return F.coalesce(*[try_format(c, f) for f in formats])


def from_epoch(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("double"))


def repair_compact(c: Column) -> Column:
    """20250101t101112 with an optional trailing sign: cut to 15 signs and parse."""
    s = F.upper(F.trim(c.cast("string")))
    s = F.when((F.length(s) == 16) & s.contains("T"), F.substr(s, F.lit(1), F.lit(15))).otherwise(s)
    return F.try_to_timestamp(F.regexp_replace(s, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))


def zone_in_text(c: Column) -> Column:
    """Zone named in a date string; a numeric offset counts as UTC."""
    out = F.when(c.rlike(r"[+-]\d{2}:?\d{2}\b"), F.lit("UTC"))
    for names, zone in lx.TIMEZONE_ABBREVIATIONS:
        out = out.when(c.rlike(rf"(?i)\b({names})\b"), F.lit(zone))
    return out


def to_zone(c: Column, zone: str | Column = "UTC") -> Column:
    """Naive times are UTC; the result is the wall-clock time of the zone."""
    return F.from_utc_timestamp(c, zone)


def dominant_zone(df: DataFrame, c: str, default: str = "UTC") -> str:
    """Most frequent zone among all values."""
    row = (
        df.select(zone_in_text(F.col(c)).alias("z")).dropna().groupBy("z").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "z").first()
    )
    return row["z"] if row else default


def format_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssZ")


def format_standard(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
