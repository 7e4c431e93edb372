"""Text features and cleaning as column expressions.

Counts that need each distinct word once fold over the sorted words: the array set functions
compare strings pairwise, which is quadratic in the length of a text.

The feature functions take the words of the text as a second column (``staged_words``), so the
text is split once per row and not once per feature.
"""

from __future__ import annotations

import functools
import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketweave.functions import lexicons as lx
from marketweave.functions.dictionary import Dictionary
from marketweave.functions.num import bound, clip, sdiv

SPACE = f"[{lx.SPACE_SIGNS}]+"
NOT_WORD = f"[^{lx.WORD_SIGNS}{lx.SPACE_SIGNS}]"


def words(c: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def _total_length(ws: Column) -> Column:
    return F.aggregate(ws, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))


def distinct_words(ws: Column) -> Column:
    """Number of different words: changes along the sorted array."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("p"))
    return F.aggregate(
        F.array_sort(ws),
        start,
        lambda acc, w: F.struct((acc.n + F.when(w.eqNullSafe(acc.p), 0).otherwise(1)).alias("n"), w.alias("p")),
        lambda acc: acc.n,
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(sdiv(a, b), F.lit(0.0))


def basic_stats(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    ws = words(t) if ws is None else ws
    chars, wc = F.length(t), F.size(ws)
    sentences = F.regexp_count(t, F.lit(r"[.!?]+"))
    digits, upper = F.regexp_count(t, F.lit(r"\p{Nd}")), F.regexp_count(t, F.lit("[A-Z]"))
    special = F.regexp_count(t, F.lit(NOT_WORD))
    return {
        "char_count": chars,
        "char_count_no_space": F.length(F.regexp_replace(t, SPACE, "")),
        "word_count": wc,
        "avg_word_length": _ratio(_total_length(ws), wc),
        "sentence_count": sentences,
        "avg_sentence_length": wc / (sentences + 1),
        "digit_count": digits,
        "uppercase_count": upper,
        "lowercase_count": F.regexp_count(t, F.lit("[a-z]")),
        "special_count": special,
        "digit_ratio": digits / (chars + 1),
        "uppercase_ratio": upper / (chars + 1),
        "special_ratio": special / (chars + 1),
    }


def linguistic(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    ws = words(t) if ws is None else ws
    wc = F.size(ws)
    unique = distinct_words(F.transform(ws, lambda w: F.lower(w)))
    lengths = F.transform(ws, lambda w: F.length(w))
    mean = _ratio(_total_length(ws), wc)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, n: acc + n * n)
    variance = F.greatest(_ratio(squares, wc) - mean * mean, F.lit(0.0))
    return {
        "unique_words": unique,
        "lexical_diversity": unique / (wc + 1),
        "word_length_mean": mean,
        "word_length_std": F.sqrt(variance),
        "word_length_max": F.coalesce(F.array_max(lengths), F.lit(0)),
        "contains_question": t.contains("?").cast("int"),
        "contains_exclamation": t.contains("!").cast("int"),
        "contains_url": t.rlike("https?://").cast("int"),
        "contains_mention": t.rlike(f"@[{lx.WORD_SIGNS}]").cast("int"),
        "contains_hashtag": t.rlike(f"#[{lx.WORD_SIGNS}]").cast("int"),
    }


def readability(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    ws = words(t) if ws is None else ws
    wc = F.size(ws)
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: s.rlike(f"[^{lx.SPACE_SIGNS}]")))
    valid = (wc > 0) & (sentences > 0)
    per_sentence, per_word = sdiv(wc, sentences), sdiv(_total_length(ws), wc)
    complex_words = F.aggregate(ws, F.lit(0), lambda acc, w: acc + F.when(F.length(w) > 6, 1).otherwise(0))
    pick = lambda e: F.when(valid, e).otherwise(F.lit(0.0))
    return {
        "flesch_score": pick(206.835 - 1.015 * per_sentence - 84.6 * per_word),
        "coleman_score": pick(5.89 * per_word - 0.3 * per_sentence - 15.8),
        "complex_word_ratio": pick(sdiv(complex_words, wc)),
    }


def count_in(ws: Column, lexicon) -> Column:
    return F.size(F.filter(ws, lambda w: w.isin(*lexicon)))


def lexicon_sentiment(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    ws = F.transform(words(t) if ws is None else ws, lambda w: F.lower(w))
    pos, neg = count_in(ws, lx.POSITIVE_WORDS), count_in(ws, lx.NEGATIVE_WORDS)
    return {
        "positive_words": pos,
        "negative_words": neg,
        "sentiment_balance": (pos - neg) / (F.size(ws) + 1),
        "emotional_intensity": F.regexp_count(t, F.lit("[!?]")) / (F.length(t) + 1),
    }


def light_features(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {
        "text_length": F.length(t),
        "word_count": F.size(words(t) if ws is None else ws),
        "has_question": t.contains("?").cast("int"),
        "has_exclamation": t.contains("!").cast("int"),
    }


# -- cleaning ---------------------------------------------------------------------------------


# A character reference behind its ampersand: decimal, hexadecimal, or a name of at most 32 signs.
REFERENCE = "^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


@functools.cache
def _reference_tables() -> tuple[list[tuple[str, str]], list[str], dict[int, str]]:
    """Names, names that need no semicolon (longest first), and the numbers that do not stand for
    themselves: all asked of the standard library, so that both agree."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    odd = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane * 0x10000 + low for plane in range(17) for low in (0xFFFE, 0xFFFF))]
    return sorted(html5.items()), bare, {n: html.unescape(f"&#{n};") for n in odd if html.unescape(f"&#{n};") != chr(n)}


def _of_number(digits: Column, base: int) -> Column:
    _, _, special = _reference_tables()
    odd = Dictionary(((str(n), t) for n, t in special.items()), "t string")
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    far = F.length(plain) > (7 if base == 10 else 6)
    number = F.when(~far, F.conv(plain, base, 10).cast("long")).otherwise(F.lit(0x110000).cast("long"))

    def sign(n: Column) -> Column:
        found = odd.find(n.cast("string"))
        lost = ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF)
        return F.when(lost, "\ufffd").when(F.size(found) > 0, F.get(found, F.lit(0))["t"]).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    return bound(number, sign)


def _of_name(name: Column) -> Column:
    names, bare, _ = _reference_tables()
    table, short = Dictionary(names, "t string"), Dictionary(((n, html5[n]) for n in bare), "t string")

    def longest(known: Column) -> Column:
        return F.when(known.isNull(), F.concat(F.lit("&"), name)).otherwise(F.concat(F.get(short.find(known), F.lit(0))["t"], F.substr(name, F.length(known) + 1)))

    def decoded(found: Column) -> Column:
        begins = F.filter(F.split(F.lit(" ".join(bare)), " "), lambda n: F.startswith(name, n))
        return F.when(F.size(found) > 0, F.get(found, F.lit(0))["t"]).otherwise(bound(F.get(begins, F.lit(0)), longest))

    return bound(table.find(name), decoded)


def _decoded(reference: Column) -> Column:
    body = F.regexp_replace(F.substr(reference, F.lit(2)), ";$", "")
    hexadecimal = F.lower(F.substr(body, F.lit(1), F.lit(1))) == "x"
    number = F.when(hexadecimal, bound(F.substr(body, F.lit(2)), lambda d: _of_number(d, 16))).otherwise(bound(body, lambda d: _of_number(d, 10)))
    return F.when(F.startswith(reference, F.lit("#")), number).otherwise(_of_name(reference))


def unescape(c: Column) -> Column:
    """All named and numeric character references, as the standard library decodes them, looked up
    inside the row. Texts without an ampersand are left alone."""

    def turned(part: Column) -> Column:
        """What stands behind an ampersand, up to the next one."""
        rest = lambda name: F.substr(part, F.length(name) + 1)
        return bound(F.regexp_extract(part, REFERENCE, 0), lambda name: F.when(name == "", F.concat(F.lit("&"), part)).otherwise(F.concat(_decoded(name), rest(name))))

    def rebuilt(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(turned(part))), "")

    return bound(c, lambda t: F.when(t.contains("&"), rebuilt(t)).otherwise(t))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def _or_null(c: Column) -> Column:
    # nullif evaluates the long expression once, a CASE would do so twice
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, lx.HTML_TAG, " ")


def drop_metadata_lines(c: Column) -> Column:
    """Drop byline lines and strip leading datelines, then join the lines."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(x))
    kept = F.filter(lines, lambda x: ~x.rlike(lx.BYLINE))
    clean = F.filter(F.transform(kept, lambda x: F.regexp_replace(x, lx.DATELINE, "")), lambda x: x != "")
    return F.array_join(clean, " ")


def sentence_case(c: Column) -> Column:
    parts = F.split(c, r"(?<=[.!?]) +")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2))))), " ")


def remove_common_words(c: Column, stop_words=None, shortest: int = 3) -> Column:
    stop = list(stop_words or lx.STOP_WORDS)
    kept = F.filter(words(c), lambda w: ~F.lower(w).isin(*stop) & (F.length(w) >= shortest))
    return F.array_join(kept, " ")


def clean_news(text: Column, case: str = "lower", level: str = "light") -> Column:
    """Plain text of a news article; null when nothing is left."""
    c = drop_metadata_lines(strip_tags(unescape(strip(text))))
    c = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    c = F.regexp_replace(c, r"[^A-Za-z0-9_\s.,!?;:()\-]", "")
    c = squeeze(c)
    c = F.lower(c) if case == "lower" else sentence_case(c) if case == "sentence" else c
    if level != "light":
        c = remove_common_words(c)
    return _or_null(squeeze(c))


def news_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{lx.WORD_SIGNS}']+"), lambda w: w != "")


def news_features(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    ws = news_words(text) if ws is None else ws
    wc = F.size(ws)
    sentences = F.greatest(F.regexp_count(t, F.lit(r"[.!?]+")), F.when(F.trim(t) != "", 1).otherwise(0))
    per_sentence, per_word = _ratio(wc, sentences), _ratio(_total_length(ws), wc)
    score = F.when((sentences > 0) & (wc > 0), clip(206.835 - 1.015 * per_sentence - 84.6 * per_word, 0.0, 100.0)).otherwise(0.0)
    return {
        "sentence_count": sentences,
        "word_count": wc,
        "avg_sentence_length": per_sentence,
        "avg_word_length": per_word,
        "unique_word_ratio": _ratio(distinct_words(ws), wc),
        "stopword_ratio": _ratio(count_in(ws, lx.STOP_WORDS), wc),
        "has_quotes": t.rlike("[\"']").cast("int"),
        "has_numbers": t.rlike("[0-9]").cast("int"),
        "readability_score": score,
    }


def expand_contractions(c: Column) -> Column:
    for short, full in lx.CONTRACTIONS:
        c = F.replace(c, F.lit(short), F.lit(full))
    return c


def clean_social(text: Column, emoji: str = "remove") -> Column:
    """Plain lower-case text of a post without markdown, links and emoji."""
    c = unescape(strip(text))
    for pattern, to in (
        (lx.USER_MENTION.replace("u/", "u/(").replace("]+", "]+)"), "$1"),
        (lx.SUBREDDIT_MENTION.replace("r/", "r/(").replace("]+", "]+)"), "$1"),
        (lx.MARKDOWN_LINK, "$1"),
        (lx.BOLD_ITALIC, "$1"),
        (lx.CODE_BLOCK, "$1"),
        (lx.QUOTE_BLOCK, ""),
        (lx.SPOILER, "$1"),
        (lx.URL, ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    if emoji == "remove":
        c = F.regexp_replace(c, lx.EMOJI_CLASS, "")
    c = expand_contractions(F.lower(c))
    c = F.regexp_replace(c, f"[^{lx.WORD_SIGNS}{lx.SPACE_SIGNS}!?]", "")
    c = F.regexp_replace(c, r"(.)\1{2,}", "$1")
    return _or_null(squeeze(c))


def social_features(text: Column, ws: Column | None = None) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    ws = words(t) if ws is None else ws
    wc = F.size(ws)
    return {
        "has_url": t.rlike(lx.URL).cast("int"),
        "has_user_mention": t.rlike(lx.USER_MENTION).cast("int"),
        "has_subreddit_mention": t.rlike(lx.SUBREDDIT_MENTION).cast("int"),
        "has_emoji": t.rlike(lx.EMOJI_CLASS).cast("int"),
        "word_count": wc,
        "char_count": F.length(t),
        "avg_word_length": _ratio(_total_length(ws), wc),
    }


# -- sentiment text ---------------------------------------------------------------------------


def clean_for_sentiment(text: Column) -> Column:
    c = F.regexp_replace(unescape(text), lx.URL, "")
    return F.lower(squeeze(F.regexp_replace(c, f"[^{lx.WORD_SIGNS}{lx.SPACE_SIGNS}!?]", "")))


def tag_negations(ws: Column) -> Column:
    """Append _NEG to the word after a negation; that word cannot itself start another pair.

    One pass of small regular-expression matches over the joined words: alternation consumes
    "negation word" pairs from left to right.
    """
    joined = F.array_join(ws, " ")
    pattern = rf"(?<![^ ])({'|'.join(lx.NEGATIONS)}) ([^ ]+)"
    return F.filter(F.split(F.regexp_replace(joined, pattern, "$1 $2_NEG"), " "), lambda w: w != "")


def sentiment_text(text: Column) -> Column:
    """The cleaned, negation-tagged text without words that carry no sentiment."""
    stop = [w for w in lx.STOP_WORDS if w not in lx.KEPT_WORDS]
    tagged = F.filter(tag_negations(words(clean_for_sentiment(text))), lambda w: ~w.isin(*stop))

    def degree(w: Column) -> Column:
        out = w
        for word, tag in lx.INTENSIFIERS.items():
            out = F.when(w == word, F.lit(tag)).otherwise(out)
        return out

    return _or_null(F.array_join(F.transform(tagged, degree), " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")
