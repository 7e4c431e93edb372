"""Queries over texts, pages, conversations, and date strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketweave.functions import datetimes as dt
from marketweave.functions import lexicons as lx
from marketweave.functions import text as tx
from marketweave.functions.num import r
from marketweave.operators import textops as to
from marketweave.plans.registry import query
from marketweave.plans.roles import table, texts

SP = rf"[{lx.SPACE_SIGNS}]"
WS = f"list_filter(regexp_split_to_array(text, '{SP}+'), lambda x: x <> '')"
WL = f"list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda x: x <> '')"


def _cnt(pattern: str, src: str = "text") -> str:
    return f"len(regexp_extract_all({src}, '{pattern}'))"


def _features(spark, sf, family, name: str = "documents", pk=("doc_id",), digits: int = 6, split=tx.words):
    real = ("ratio", "avg", "diversity", "mean", "std", "score", "balance", "intensity")
    df, parts = to.add_features(texts(spark, sf, name).select(*pk, "text"), "text", family, split=split)
    return df.select(*pk, *[r(c, digits).alias(n) if any(k in n for k in real) else c.cast("long").alias(n) for n, c in parts.items()])


@query(
    "text_basic_statistics",
    rf"""WITH d AS (SELECT doc_id, text, {WS} AS ws FROM documents)
    SELECT doc_id, length(text) AS char_count, length(regexp_replace(text, '{SP}+', '', 'g')) AS char_count_no_space, len(ws) AS word_count,
      round(coalesce(list_sum(list_transform(ws, lambda w: length(w))) / nullif(len(ws), 0), 0), 6) AS avg_word_length, {_cnt('[.!?]+')} AS sentence_count,
      round(len(ws) / ({_cnt('[.!?]+')} + 1), 6) AS avg_sentence_length, {_cnt(chr(92) + 'p{Nd}')} AS digit_count, {_cnt('[A-Z]')} AS uppercase_count, {_cnt('[a-z]')} AS lowercase_count,
      {_cnt(f'[^{lx.WORD_SIGNS}{lx.SPACE_SIGNS}]')} AS special_count, round({_cnt(chr(92) + 'p{Nd}')} / (length(text) + 1), 6) AS digit_ratio, round({_cnt('[A-Z]')} / (length(text) + 1), 6) AS uppercase_ratio,
      round({_cnt(f'[^{lx.WORD_SIGNS}{lx.SPACE_SIGNS}]')} / (length(text) + 1), 6) AS special_ratio FROM d""",
)
def text_basic_statistics(spark, sf):
    return _features(spark, sf, tx.basic_stats)


@query(
    "text_linguistic_features",
    rf"""WITH d AS (SELECT doc_id, text, {WS} AS ws, {WL} AS wl FROM documents), e AS (SELECT *, list_transform(ws, lambda w: length(w)) AS ln FROM d)
    SELECT doc_id, len(list_distinct(wl)) AS unique_words, round(len(list_distinct(wl)) / (len(ws) + 1), 6) AS lexical_diversity,
      round(coalesce(list_avg(ln), 0), 6) AS word_length_mean, round(coalesce(list_stddev_pop(ln), 0), 6) AS word_length_std, CAST(coalesce(list_max(ln), 0) AS BIGINT) AS word_length_max,
      CAST(contains(text, '?') AS BIGINT) AS contains_question, CAST(contains(text, '!') AS BIGINT) AS contains_exclamation, CAST(regexp_matches(text, 'https?://') AS BIGINT) AS contains_url,
      CAST(regexp_matches(text, '@[{lx.WORD_SIGNS}]') AS BIGINT) AS contains_mention, CAST(regexp_matches(text, '#[{lx.WORD_SIGNS}]') AS BIGINT) AS contains_hashtag FROM e""",
)
def text_linguistic_features(spark, sf):
    return _features(spark, sf, tx.linguistic)


@query(
    "text_readability_scores",
    rf"""WITH d AS (SELECT doc_id, {WS} AS ws, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{lx.SPACE_SIGNS}]')) AS ss FROM documents),
    e AS (SELECT doc_id, len(ws) > 0 AND len(ss) > 0 AS ok, len(ws) / nullif(len(ss), 0) AS ps, list_sum(list_transform(ws, lambda w: length(w))) / nullif(len(ws), 0) AS pw,
          len(list_filter(ws, lambda w: length(w) > 6)) / nullif(len(ws), 0) AS cr FROM d)
    SELECT doc_id, round(CASE WHEN ok THEN 206.835 - 1.015 * ps - 84.6 * pw ELSE 0 END, 8) AS flesch_score, round(CASE WHEN ok THEN 5.89 * pw - 0.3 * ps - 15.8 ELSE 0 END, 8) AS coleman_score,
      round(CASE WHEN ok THEN cr ELSE 0 END, 8) AS complex_word_ratio FROM e""",
)
def text_readability_scores(spark, sf):
    return _features(spark, sf, tx.readability, digits=8)


def _sql_in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


@query(
    "text_lexicon_sentiment",
    rf"""WITH d AS (SELECT doc_id, text, {WL} AS wl FROM documents), e AS (SELECT *, len(list_filter(wl, lambda w: w IN {_sql_in(lx.POSITIVE_WORDS)})) AS p, len(list_filter(wl, lambda w: w IN {_sql_in(lx.NEGATIVE_WORDS)})) AS n FROM d)
    SELECT doc_id, p AS positive_words, n AS negative_words, round((p - n) / (len(wl) + 1), 6) AS sentiment_balance, round({_cnt('[!?]')} / (length(text) + 1), 6) AS emotional_intensity FROM e""",
)
def text_lexicon_sentiment(spark, sf):
    return _features(spark, sf, tx.lexicon_sentiment)


@query(
    "conversation_light_features",
    rf"""SELECT conv_id, turn, length(text) AS text_length, len({WS}) AS word_count, CAST(contains(text, '?') AS BIGINT) AS has_question, CAST(contains(text, '!') AS BIGINT) AS has_exclamation FROM conversations""",
)
def conversation_light_features(spark, sf):
    return _features(spark, sf, tx.light_features, "conversations", ("conv_id", "turn"))


_TERMS = rf"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^{lx.WORD_SIGNS}]+'), lambda w: length(w) >= 2 AND w NOT IN {_sql_in(lx.STOP_WORDS)}) AS ws FROM documents),
  e AS (SELECT doc_id, unnest(ws || list_filter(list_transform(ws, lambda w, i: w || ' ' || ws[i + 1]), lambda g: g IS NOT NULL)) AS term FROM t),
  v AS (SELECT term FROM e GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 50), tf AS (SELECT doc_id, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM v) GROUP BY 1, 2),
  idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1)"""


@query(
    "text_term_weights",
    f"""WITH {_TERMS}, w AS (SELECT doc_id, tf.term, tf, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term)
    SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def text_term_weights(spark, sf):
    out = to.term_weights(texts(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "term", "tf", r("weight").alias("weight"))


# The references that the given texts hold; the ampersand, also without its end, last.
_SQL_REFERENCES = (("&copy;", 169), ("&middot;", 183), ("&quot;", 34), ("&lt;", 60), ("&gt;", 62), ("&#39;", 39), ("&nbsp;", 160), ("&eacute;", 233), ("&#8217;", 8217))


def _sql_unescape(c: str) -> str:
    for entity, code in _SQL_REFERENCES:
        c = f"replace({c}, '{entity}', chr({code}))"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def _sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'), ' ')"


def _sql_news(src: str, c: str, pk: str) -> str:
    tags = f"regexp_replace({_sql_unescape(_sql_strip(c))}, '{lx.HTML_TAG}', ' ', 'g')"
    lines = f"list_transform(string_split({tags}, chr(10)), lambda x: {_sql_strip('x')})"
    kept = f"list_filter({lines}, lambda x: NOT regexp_matches(x, '{lx.BYLINE}'))"
    clean = f"list_filter(list_transform({kept}, lambda x: regexp_replace(x, '{lx.DATELINE}', '')), lambda x: x <> '')"
    body = f"array_to_string({clean}, ' ')"
    ascii_only = f"regexp_replace({body}, '[^\\x00-\\x7F]', '', 'g')"
    plain = f"regexp_replace({ascii_only}, '[^A-Za-z0-9_\\s.,!?;:()\\-]', '', 'g')"
    return f"SELECT {pk}, nullif(lower({_sql_squeeze(plain)}), '') AS clean FROM {src}"


@query("news_text_cleaning", _sql_news("pages", "html", "page_id"))
def news_text_cleaning(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.clean_news(F.col("html")).alias("clean"))


@query(
    "news_text_without_common_words",
    f"""WITH c AS ({_sql_news("pages", "html", "page_id")})
    SELECT page_id, nullif(array_to_string(list_filter(string_split(clean, ' '), lambda w: w NOT IN {_sql_in(lx.STOP_WORDS)} AND length(w) >= 3), ' '), '') AS clean FROM c""",
)
def news_text_without_common_words(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.clean_news(F.col("html"), level="medium").alias("clean"))


@query(
    "news_text_features",
    rf"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^{lx.WORD_SIGNS}'']+'), lambda x: x <> '') AS ws,
      greatest({_cnt('[.!?]+')}, CASE WHEN trim(text, ' ') <> '' THEN 1 ELSE 0 END) AS sc FROM documents),
    e AS (SELECT *, coalesce(len(ws) / nullif(sc, 0), 0) AS ps, coalesce(list_sum(list_transform(ws, lambda w: length(w))) / nullif(len(ws), 0), 0) AS pw FROM d)
    SELECT doc_id, CAST(sc AS BIGINT) AS sentence_count, len(ws) AS word_count, round(ps, 6) AS avg_sentence_length, round(pw, 6) AS avg_word_length,
      round(coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0), 6) AS unique_word_ratio, round(coalesce(len(list_filter(ws, lambda w: w IN {_sql_in(lx.STOP_WORDS)})) / nullif(len(ws), 0), 0), 6) AS stopword_ratio,
      CAST(contains(text, chr(34)) OR contains(text, chr(39)) AS BIGINT) AS has_quotes, CAST(regexp_matches(text, '[0-9]') AS BIGINT) AS has_numbers,
      round(CASE WHEN sc > 0 AND len(ws) > 0 THEN least(greatest(206.835 - 1.015 * ps - 84.6 * pw, 0), 100) ELSE 0 END, 6) AS readability_score FROM e""",
)
def news_text_features(spark, sf):
    return _features(spark, sf, tx.news_features, split=tx.news_words)


@query("social_text_cleaning")
def social_text_cleaning(spark, sf):
    """Needs a back-reference (runs of one sign), which the SQL engine's patterns lack."""
    return texts(spark, sf, "documents").select("doc_id", tx.clean_social(F.col("text")).alias("clean"))


@query(
    "social_text_features",
    rf"""SELECT conv_id, turn, CAST(regexp_matches(text, '{lx.URL}') AS BIGINT) AS has_url, CAST(regexp_matches(text, '{lx.USER_MENTION}') AS BIGINT) AS has_user_mention,
      CAST(regexp_matches(text, '{lx.SUBREDDIT_MENTION}') AS BIGINT) AS has_subreddit_mention, CAST(regexp_matches(text, '{lx.EMOJI_CLASS}') AS BIGINT) AS has_emoji, len({WS}) AS word_count,
      length(text) AS char_count, round(coalesce(list_sum(list_transform({WS}, lambda w: length(w))) / nullif(len({WS}), 0), 0), 6) AS avg_word_length FROM conversations""",
)
def social_text_features(spark, sf):
    return _features(spark, sf, tx.social_features, "conversations", ("conv_id", "turn"))


_SQL_SENT_CLEAN = (
    f"lower({_sql_squeeze(f'''regexp_replace(regexp_replace({_sql_unescape('text')}, '{lx.URL}', '', 'g'), '[^{lx.WORD_SIGNS}{lx.SPACE_SIGNS}!?]', '', 'g')''')})"
)


@query("sentiment_text_cleaning", f"SELECT doc_id, {_SQL_SENT_CLEAN} AS clean FROM documents")
def sentiment_text_cleaning(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.clean_for_sentiment(F.col("text")).alias("clean"))


@query("sentiment_text_preparation")
def sentiment_text_preparation(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.sentiment_text(F.col("text")).alias("prepared"))


# A small polarity lexicon made of words that occur in the texts.
LEXICON = (
    ("the", 0.05, 0.1), ("with", 0.4, 0.3), ("for", 0.2, 0.2), ("was", -0.3, 0.6), ("which", -0.15, 0.4), ("und", 0.3, 0.5), ("der", -0.2, 0.2),
    ("les", 0.25, 0.1), ("dans", -0.5, 0.9), ("que", 0.6, 0.7), ("no", -0.8, 0.9),
)


def _lexicon(spark):
    return spark.createDataFrame(list(LEXICON), "word string, polarity double, subjectivity double")


_SQL_LEX = f"""lx AS (SELECT * FROM (VALUES {', '.join(str(x) for x in LEXICON)}) v(word, polarity, subjectivity)),
  w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM documents),
  h AS (SELECT doc_id, count(*) FILTER (polarity > 0.1) AS p, count(*) FILTER (polarity < -0.1) AS n, avg(polarity) AS pol, avg(subjectivity) AS sub FROM w JOIN lx USING (word) GROUP BY 1),
  c AS (SELECT doc_id, lang, text, len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS wc FROM documents),
  s AS (SELECT c.doc_id, lang, wc AS word_count, coalesce(p, 0) AS positive_words, coalesce(n, 0) AS negative_words, coalesce(pol, 0) AS polarity, coalesce(sub, 0) AS subjectivity, text FROM c LEFT JOIN h ON c.doc_id = h.doc_id)"""


@query(
    "text_polarity_scores",
    rf"""WITH {_SQL_LEX} SELECT doc_id, word_count, positive_words, negative_words, round(polarity, 9) AS polarity, round(subjectivity, 9) AS subjectivity,
      round(coalesce(positive_words / nullif(word_count, 0), 0), 6) AS positive_ratio, round(coalesce(negative_words / nullif(word_count, 0), 0), 6) AS negative_ratio,
      CAST(regexp_matches(text, '(?i)\b({'|'.join(lx.NEGATIONS)})\b') AS INT) AS has_negation, {_cnt('!')} AS exclamations, {_cnt(chr(92) + '?')} AS questions FROM s""",
)
def text_polarity_scores(spark, sf):
    out = to.lexicon_scores(texts(spark, sf, "documents"), "doc_id", "text", _lexicon(spark))
    real = ("polarity", "subjectivity", "positive_ratio", "negative_ratio")
    return out.select(*[r(c, 9 if c in real[:2] else 6).alias(c) if c in real else F.col(c) for c in out.columns])


@query(
    "corpus_polarity",
    f"""WITH {_SQL_LEX} SELECT lang, round(avg(polarity), 6) AS polarity, round(avg(subjectivity), 6) AS subjectivity, count(*) AS "count",
      round(avg(polarity) * (1 - avg(subjectivity)), 6) AS sentiment_score FROM s GROUP BY lang""",
)
def corpus_polarity(spark, sf):
    scored = to.lexicon_scores(texts(spark, sf, "documents"), "doc_id", "text", _lexicon(spark), ["lang"])
    out = to.corpus_polarity(scored, ["lang"])
    return out.select("lang", *[r(c).alias(c) for c in ("polarity", "subjectivity", "sentiment_score")], "count")


@query(
    "text_column_characteristics",
    rf"""WITH d AS (SELECT text, {WS} AS ws, {WL} AS wl FROM documents), u AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(wl) AS w FROM d))
    SELECT 'text' AS "column", round(avg(len(ws)), 6) AS avg_words, round(avg(length(text)), 6) AS avg_chars, CAST(sum(len(wl)) AS BIGINT) AS total_words, CAST(bool_or(regexp_matches(text, 'https?://')) AS INT) AS has_urls,
      CAST(bool_or(regexp_matches(text, '@[{lx.WORD_SIGNS}]')) AS INT) AS has_mentions, CAST(bool_or(regexp_matches(text, '#[{lx.WORD_SIGNS}]')) AS INT) AS has_hashtags,
      CAST(bool_or(regexp_matches(text, '{lx.HTML_TAG}')) AS INT) AS has_html, any_value(v) AS vocabulary, round(any_value(v) / sum(len(wl)), 6) AS richness FROM d, u""",
)
def text_column_characteristics(spark, sf):
    out = to.text_characteristics(texts(spark, sf, "documents"), ["text"])
    return out.select(*[r(c).alias(c) if c in ("avg_words", "avg_chars", "richness") else F.col(c) for c in out.columns])


@query("text_columns_cleaned", _sql_news("conversations", "text", "conv_id, turn").replace("AS clean FROM", "AS text_clean FROM"))
def text_columns_cleaned(spark, sf):
    """The cleaned texts themselves, by the processor that the column's name asks for."""
    return to.preprocess_columns(texts(spark, sf, "conversations"), ["text"], "auto")[0].select("conv_id", "turn", "text_clean")


@query("text_columns_preprocessed")
def text_columns_preprocessed(spark, sf):
    return to.preprocess_columns(texts(spark, sf, "conversations"), ["text"], "auto")[1]


# -- date strings -----------------------------------------------------------------------------

_STYLES = ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+0000'")


def _date_strings(spark, sf):
    """The event times written in several styles, some of them unreadable."""
    e = table(spark, sf, "events").select("event_id", "ts")
    k = F.pmod("event_id", F.lit(4))
    s = F.when(k == 3, F.lit("not a date"))
    for i, style in enumerate(_STYLES):
        s = s.when(k == i, F.date_format("ts", style))
    return e.select("event_id", "ts", s.alias("s"))


@query(
    "datetime_parsing",
    "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN date_trunc('second', ts) END AS parsed FROM events",
)
def datetime_parsing(spark, sf):
    return _date_strings(spark, sf).select("event_id", dt.parse_datetime(F.col("s")).alias("parsed"))


@query(
    "timezone_normalisation",
    """SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'US/Eastern' AS TIMESTAMP) AS eastern, date_trunc('day', ts) AS day_start,
      strftime(ts, '%Y-%m-%dT%H:%M:%S+0000') AS iso, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS from_epoch, date_trunc('second', ts) AS repaired FROM events""",
)
def timezone_normalisation(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    compact = F.concat(F.lower(F.date_format("ts", "yyyyMMdd'T'HHmmss")), F.lit("z"))
    return e.select(
        "event_id", dt.to_zone(F.col("ts"), "US/Eastern").alias("eastern"), F.date_trunc("day", "ts").alias("day_start"), dt.format_iso(F.col("ts")).alias("iso"),
        dt.from_epoch(F.unix_timestamp("ts")).alias("from_epoch"), dt.repair_compact(compact).alias("repaired"),
    )


@query(
    "timezone_names_in_text",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'US/Eastern' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'UTC' WHEN 3 THEN 'Europe/Paris' END AS zone FROM orders""",
)
def timezone_names_in_text(spark, sf):
    o = table(spark, sf, "orders")
    tail = F.element_at(F.array(*[F.lit(x) for x in (" EST", " jst", "+0800", " CEST", "")]), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    s = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm"), tail)
    return o.select("o_orderkey", dt.zone_in_text(s).alias("zone"))


@query(
    "dominant_timezone",
    "SELECT event_id, ts - INTERVAL 5 HOUR AS local_ts FROM events",
)
def dominant_timezone(spark, sf):
    """All strings carry EST; the inferred zone is then applied to the whole column (January)."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.withColumn("s", F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm"), F.lit(" EST")))
    return e.select("event_id", dt.to_zone(F.col("ts"), dt.dominant_zone(s, "s")).alias("local_ts"))
