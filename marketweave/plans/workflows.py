"""Whole routes: prepare a table, integrate texts with bars, label, train."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions import scalar as sc
from marketweave.functions import text as tx
from marketweave.functions.num import datetime_columns, numeric_columns
from marketweave.operators import integrate as ig
from marketweave.operators import outliers as ol
from marketweave.operators import quality as ql
from marketweave.operators import scaling as scl
from marketweave.operators.features import statistical_features
from marketweave.session import cut


def integrate_panel(bars: DataFrame, docs: DataFrame, dated: DataFrame, aliases: DataFrame) -> DataFrame:
    """Match texts to entities, date them, aggregate per entity and day, left join on the bars."""
    hits = ig.match_entities(docs, "text", ["doc_id"], aliases)
    daily = (
        hits.join(dated, "doc_id")
        .groupBy(F.col("entity").cast("long").alias("key"), "day")
        .agg(F.count(F.lit(1)).alias("news_count"), F.avg("score").alias("news_sentiment"))
    )
    return ig.attach_daily(bars, daily, ["key", "day"])


def prepare_table(df: DataFrame, text: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The preparation chain in one go: impute, type, standardise dates, clean text, add features,
    scale, treat outliers. ``keep`` names identifiers that only pass through.

    Steps that learn from the table work on a written copy of the rows, so no earlier step is
    computed twice.
    """
    filled = _impute_body(df, keep) if keep else ql.impute(df)
    typed = cut(_convert_body(filled, [*keep, *text]))
    dates = [c for c in datetime_columns(typed) if c not in keep]
    numbers = [c for c in numeric_columns(typed) if c not in keep]
    out = typed
    for c in dates:
        parts = {**sc.calendar_features(F.col(c)), **sc.seasonal_features(F.col(c))}
        out = out.withColumns({f"{c}_{n}": e for n, e in parts.items()})
    for c in text:
        out = out.withColumns({f"{c}_clean": tx.clean_social(F.col(c)), **{f"{c}_{n}": e for n, e in tx.light_features(F.col(c)).items()}})
    if numbers:
        out = statistical_features(out, numbers)
        treated = ol.cap(out, numbers)
        out = scl.transform(treated, scl.fit(treated, scl.recommend(typed, numbers)))
    return out


def _impute_body(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Impute all columns but the identifiers, which travel as one struct."""
    packed = df.select(F.struct(*keep).alias("__keep"), *[c for c in df.columns if c not in keep])
    done = ql.impute(packed)
    return done.select("__keep.*", *[c for c in done.columns if c != "__keep"])


def _convert_body(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in keep]
    return ql.convert(df, ql.mapping_of(ql.type_scores(df, strings))) if strings else df
