"""Daily aggregates of news and posts, text-to-entity matching, joins on bars, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.num import numeric_columns, sdiv

SMALL_LOOKUP = 10_000
IN_ROW_ALIASES = 500


def daily_sentiment(df: DataFrame, keys: Sequence[str], score: str, text: str, digits: int = 4) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(text).alias("article_count"),
        F.round(F.avg(score), digits).alias("sentiment_avg"),
        F.round(F.stddev_samp(score), digits).alias("sentiment_std"),
        F.round(F.min(score), digits).alias("sentiment_min"),
        F.round(F.max(score), digits).alias("sentiment_max"),
    )


def daily_activity(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, and mean and sum of each metric, in one aggregate."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("post_count"),
        *[F.avg(m).alias(f"{m}_avg") for m in metrics],
        *[F.sum(m).alias(f"{m}_sum") for m in metrics],
    )


def daily_any(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Row count and mean of the columns of any source, by default of all numeric ones."""
    cols = [c for c in cols or numeric_columns(df) if c not in keys]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *[F.avg(c).alias(f"{c}_avg") for c in cols])


def attach_daily(bars: DataFrame, agg: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of an already aggregated source; Spark broadcasts it when its size allows."""
    return bars.join(agg, list(on), "left")


def contains_any(cols: Sequence[str], aliases: Sequence[str]) -> Column:
    """Case-insensitive: any alias inside any of the columns."""
    out = F.lit(False)
    for c in cols:
        for a in aliases:
            out = out | F.coalesce(F.upper(c).contains(a.upper()), F.lit(False))
    return out


def mentions_symbol(c: str, symbol: str) -> Column:
    return F.col(c).rlike(rf"(?i)\$?\b{symbol}\b")


def upper_words(text: Column) -> Column:
    return F.filter(F.split(F.upper(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_grams(words: Column, longest: int) -> Column:
    """Runs of 1..longest words, repeats included (they end in the distinct of the join)."""
    # zip_with evaluates its inputs once per row; slicing inside a lambda would do so per word
    out = grams = words
    for n in range(2, longest + 1):
        tail = F.slice(words, n, F.greatest(F.size(words), F.lit(0)))
        grams = F.filter(F.zip_with(grams, tail, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
        out = F.concat(out, grams)
    return out


def match_entities(docs: DataFrame, text: str, pk: Sequence[str], aliases: DataFrame) -> DataFrame:
    """(pk, entity) for every entity with at least one alias as whole words of the text.

    ``aliases`` has (entity, alias). Words and word runs of the text meet the aliases in an equi
    join, for all entities at once; a small alias table is broadcast after its size was counted.
    """
    norm = aliases.select(
        "entity", F.array_join(upper_words(F.col("alias")), " ").alias("__gram")
    ).distinct()
    size, longest = norm.agg(F.count(F.lit(1)), F.max(F.size(F.split("__gram", " ")))).first()
    staged = docs.select(*pk, upper_words(F.col(text)).alias("__ws"))
    runs = word_grams(F.col("__ws"), longest or 1)
    if 0 < size <= IN_ROW_ALIASES:
        # few aliases: drop the other runs before they become rows
        wanted = [r["__gram"] for r in norm.select("__gram").distinct().collect()]
        runs = F.filter(runs, lambda g: g.isin(*wanted))
    grams = staged.select(*pk, F.explode(runs).alias("__gram"))
    side = F.broadcast(norm) if size <= SMALL_LOOKUP else norm
    return grams.join(side, "__gram").select(*pk, "entity").distinct()


def match_entities_contains(docs: DataFrame, text: Sequence[str], pk: Sequence[str], aliases: dict[str, Sequence[str]]) -> DataFrame:
    """The same by substring, row by row without a join, for short alias lists."""
    hits = F.array_compact(F.array(*[F.when(contains_any(text, names), F.lit(e)) for e, names in aliases.items()]))
    return docs.select(*pk, F.explode(hits).alias("entity"))


def coverage(bars: DataFrame, keys: Sequence[str], counted: str) -> DataFrame:
    """Bars with and without a joined value per key."""
    have = F.count_if(F.col(counted).isNotNull())
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), have.alias("covered"), (sdiv(have, F.count(F.lit(1))) * 100).alias("coverage_pct")
    )


def uncovered(bars: DataFrame, agg: DataFrame, on: Sequence[str]) -> DataFrame:
    return bars.join(agg, list(on), "left_anti")


def shared_dates(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).intersect(b.select(on))


def normalised_activity(df: DataFrame, c: str) -> DataFrame:
    """count / overall maximum, missing counts as 0; unscaled when the maximum is 0."""
    peak = df.agg(F.max(c)).first()[0]
    filled = F.coalesce(F.col(c), F.lit(0))
    return df.withColumn(f"{c}_normalized", filled / F.lit(float(peak)) if peak else filled.cast("double"))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
