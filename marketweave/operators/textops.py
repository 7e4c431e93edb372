"""Text operators that need more than one row: TF-IDF, lexicon scores, column characteristics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions import lexicons as lx
from marketweave.functions import text as tx
from marketweave.functions.dictionary import Dictionary
from marketweave.functions.num import sdiv
from marketweave.operators.integrate import SMALL_LOOKUP
from marketweave.session import cut


def add_features(df: DataFrame, text: str, *families, split=tx.words) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with the words of the text as a column, and the feature columns over it."""
    staged = df.withColumn("__ws", split(F.coalesce(F.col(text), F.lit(""))))
    out: dict[str, Column] = {}
    for family in families:
        out.update(family(F.col(text), F.col("__ws")))
    return staged, out


def content_words(text: Column, stop_words: Sequence[str] = lx.STOP_WORDS) -> Column:
    """Words of two or more signs without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{lx.WORD_SIGNS}]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))


def _pairs(ws: Column) -> Column:
    """The pairs of neighbours, null where one of them is."""
    tail = F.slice(ws, 2, F.greatest(F.size(ws), F.lit(0)))
    return F.zip_with(ws, tail, lambda a, b: F.concat(a, F.lit(" "), b))


def _rows(df: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """A row per term that is not null. A plain explode would make Spark filter by the size of the array
    first, for which it would split each text a second time."""
    return df.select(*keep, F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())


def term_weights(docs: DataFrame, pk: str, text: str, vocabulary: int = 50, method: str = "tfidf") -> DataFrame:
    """(pk, term, tf, weight) for the most frequent terms of the collection.

    Words are counted first. A pair is at most as frequent as the rarer of its words, so only pairs
    of words as frequent as the last word that could be chosen are counted at all; the terms are
    chosen from both exactly. The last pass makes rows of vocabulary terms only and writes their counts,
    so each text is split three times in all.
    """
    found = docs.select(pk, content_words(F.col(text)).alias("__ws"))
    count = lambda df: df.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    words = cut(count(_rows(found, F.col("__ws"))))
    chosen = words.orderBy(F.desc("n"), "term").limit(vocabulary).collect()  # at most `vocabulary` rows
    least = chosen[-1]["n"] if len(chosen) == vocabulary else 0
    frequent = [r["term"] for r in words.where(F.col("n") >= least).select("term").limit(SMALL_LOOKUP + 1).collect()]
    both = F.col("__ws")
    if 0 < len(frequent) <= SMALL_LOOKUP:  # else nearly all words tie: count all pairs
        # other words end a pair, as null
        both = F.transform("__ws", lambda w: F.when(w.isin(*frequent), w))
    counted = words.where(F.col("n") >= least).unionByName(count(_rows(found, _pairs(both))))
    names = [r["term"] for r in counted.orderBy(F.desc("n"), "term").limit(vocabulary).collect()]
    parts = sorted({w for name in names for w in name.split(" ")})
    kept = F.transform("__ws", lambda w: F.when(w.isin(*parts) if parts else F.lit(False), w))
    pieces = found.select(pk, kept.alias("__ws"))
    kept = F.filter(F.concat("__ws", _pairs(F.col("__ws"))), lambda t: t.isin(*names) if names else F.lit(False))
    tf = cut(_rows(pieces, kept, pk).groupBy(pk, "term").agg(F.count(F.lit(1)).alias("tf")))  # at most `vocabulary` rows a text
    if method == "count":
        return tf.withColumn("weight", F.col("tf").cast("double"))
    n = docs.count()
    idf = tf.groupBy("term").agg((F.ln((1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    # at most `vocabulary` rows per document meet in one group
    norm = raw.groupBy(pk).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, pk).select(pk, "term", "tf", sdiv("w", "norm").alias("weight"))


def polarity_columns(text: Column, ws: Column, entries: Dictionary) -> dict[str, Column]:
    """Counts and means over the lexicon entries of a text's words, inside the row."""
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("size"))

    def add(acc: Column, e: Column) -> Column:
        return F.struct(
            (acc["p"] + (e["polarity"] > 0.1).cast("int")).alias("p"), (acc["n"] + (e["polarity"] < -0.1).cast("int")).alias("n"),
            (acc["a"] + e["polarity"]).alias("a"), (acc["b"] + e["subjectivity"]).alias("b"), (acc["size"] + 1).alias("size"),
        )

    def result(acc: Column) -> Column:
        mean = lambda c: F.coalesce(sdiv(acc[c], acc["size"]), F.lit(0.0))
        return F.struct(acc["p"].cast("long").alias("positive_words"), acc["n"].cast("long").alias("negative_words"), mean("a").alias("polarity"), mean("b").alias("subjectivity"))

    t = F.coalesce(text, F.lit(""))
    return {
        "word_count": F.size(ws),
        "has_negation": t.rlike(rf"(?i)\b({'|'.join(lx.NEGATIONS)})\b").cast("int"),
        "exclamations": F.regexp_count(t, F.lit("!")),
        "questions": F.regexp_count(t, F.lit(r"\?")),
        "__found": F.aggregate(entries.find_all(ws), zero, add, result),
    }


def lexicon_scores(docs: DataFrame, pk: str, text: str, lexicon: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Word counts and mean polarity per text from a lexicon table (word, polarity, subjectivity), with
    the columns of ``keep``.

    A lexicon of at most SMALL_LOOKUP words becomes a dictionary inside the row: one pass over the
    texts, no row per word and no shuffle. A larger one is joined word by word.
    """
    ws = tx.tokens(F.col(text))
    known = lexicon.select("word", F.col("polarity").cast("double"), F.col("subjectivity").cast("double")).where("word IS NOT NULL").limit(SMALL_LOOKUP + 1).collect()
    # polarity and subjectivity are null together: such entries count for nothing
    if len(known) <= SMALL_LOOKUP:
        entries = Dictionary(((r["word"], r["polarity"], r["subjectivity"]) for r in known if r["polarity"] is not None and r["subjectivity"] is not None), "polarity double, subjectivity double")
        staged = docs.select(pk, *keep, F.col(text).alias("__t"), ws.alias("__ws"))
        out = staged.select(pk, *keep, *[c.alias(n) for n, c in polarity_columns(F.col("__t"), F.col("__ws"), entries).items()])
        out = out.select(pk, *keep, "word_count", "has_negation", "exclamations", "questions", "__found.*")
    else:
        hits = docs.select(pk, F.explode(ws).alias("word")).join(lexicon, "word").groupBy(pk).agg(
            F.count_if(F.col("polarity") > 0.1).alias("positive_words"), F.count_if(F.col("polarity") < -0.1).alias("negative_words"),
            F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"),
        )
        none = Dictionary([], "polarity double, subjectivity double")
        base = docs.select(pk, *keep, *[c.alias(n) for n, c in polarity_columns(F.col(text), ws, none).items() if n != "__found"])
        out = base.join(hits, pk, "left").fillna(0, ["positive_words", "negative_words"]).fillna(0.0, ["polarity", "subjectivity"])
    return out.withColumns(
        {
            "positive_ratio": F.coalesce(sdiv("positive_words", "word_count"), F.lit(0.0)),
            "negative_ratio": F.coalesce(sdiv("negative_words", "word_count"), F.lit(0.0)),
        }
    )


def corpus_polarity(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean polarity and subjectivity; score = polarity * (1 - subjectivity)."""
    out = scored.groupBy(*keys).agg(
        F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"), F.count(F.lit(1)).alias("count")
    )
    return out.withColumn("sentiment_score", F.col("polarity") * (1 - F.col("subjectivity")))


def text_characteristics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per text column: sizes, vocabulary and which kinds of marks occur."""
    out = None
    for c in cols:
        t = F.coalesce(F.col(c), F.lit(""))
        ws = tx.words(F.lower(t))
        plain = df.agg(
            F.avg(F.size(tx.words(t))).alias("avg_words"),
            F.avg(F.length(t)).alias("avg_chars"),
            F.sum(F.size(ws)).alias("total_words"),
            F.coalesce(F.bool_or(t.rlike("https?://")), F.lit(False)).cast("int").alias("has_urls"),
            F.coalesce(F.bool_or(t.rlike(f"@[{lx.WORD_SIGNS}]")), F.lit(False)).cast("int").alias("has_mentions"),
            F.coalesce(F.bool_or(t.rlike(f"#[{lx.WORD_SIGNS}]")), F.lit(False)).cast("int").alias("has_hashtags"),
            F.coalesce(F.bool_or(t.rlike(lx.HTML_TAG)), F.lit(False)).cast("int").alias("has_html"),
        )
        vocab = df.select(F.explode(ws).alias("w")).agg(F.count_distinct("w").alias("vocabulary"))
        row = plain.crossJoin(F.broadcast(vocab)).select(  # one row each
            F.lit(c).alias("column"), "*", F.coalesce(sdiv("vocabulary", "total_words"), F.lit(0.0)).alias("richness")
        )
        out = row if out is None else out.unionByName(row)
    return out


# Kinds by parts of the column name; the first that fits counts.
KIND_OF_NAME = (
    ("title", ("title", "headline", "subject")), ("content", ("content", "body", "text", "article", "description")),
    ("social", ("comment", "post", "reddit", "social")), ("sentiment", ("review", "sentiment", "opinion", "feedback")),
    ("summary", ("summary", "abstract", "executive")),
)


def text_kind(name: str, traits: dict) -> str:
    """Name first, then content."""
    for kind, parts in KIND_OF_NAME:
        if any(p in name.lower() for p in parts):
            return kind
    if any(traits.get(k) for k in ("has_mentions", "has_hashtags", "has_urls")):
        return "social"
    words, chars = traits.get("avg_words") or 0, traits.get("avg_chars") or 0
    return "content" if words > 50 and chars > 200 else "title" if words < 20 and chars < 150 else "general"


PROCESSORS = {k: tx.clean_news for k in ("title", "content", "summary", "general", "news")} | {"social": tx.clean_social, "sentiment": tx.sentiment_text}


def preprocess_columns(df: DataFrame, cols: Sequence[str], processor: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Cleaned copy of each column as ``{c}_clean`` and a metrics table. With "auto" each column
    gets its own processor."""
    chosen = {}
    if processor == "auto":
        for row in text_characteristics(df, cols).collect():  # one row per column
            chosen[row["column"]] = text_kind(row["column"], row.asDict())
    else:
        chosen = {c: processor for c in cols}
    out = df.withColumns({f"{c}_clean": PROCESSORS[chosen[c]](F.col(c)) for c in cols})
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(chosen[c]).alias("processor"),
            (sdiv(F.count(f"{c}_clean"), F.count(F.lit(1))) * 100).alias("success_rate"),
            F.avg(F.length(c)).alias("avg_length_before"),
            F.avg(F.length(f"{c}_clean")).alias("avg_length_after"),
        )
        for c in cols
    ]
    return out, out.agg(F.array(*rows).alias("__m")).select(F.inline("__m"))
