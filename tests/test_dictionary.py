"""Look-ups inside the row against the standard library and against joins."""

import html
import random
from collections import Counter
from html.entities import html5

from pyspark.sql import functions as F

from marketweave.functions import text as tx
from marketweave.functions.dictionary import Dictionary
from marketweave.operators import textops as to


def test_every_character_reference(spark):
    rng = random.Random(3)
    names = sorted(html5)
    texts = [f"a&{n}b" for n in names] + [f"&{n}x;" for n in names[::5]] + [f"&{n.upper()}" for n in names[::7]]
    numbers = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**7, 10**12]
    texts += [f"&#{n};" for n in numbers] + [f"&#x{n:x}" for n in numbers] + [f"&#X{n:X}; &#000{n}z" for n in numbers[::3]]
    texts += ["&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&amp;amp;", "&notit;", "&notin;", "&ampere", "&\n", "x&" + "y" * 40 + ";", "no reference", "", "1 &lt 2 &gt; 1"]
    texts += ["".join(rng.choice(["&", "amp", "lt;", "#", "x", "3", "9;", " ", "not", "é"]) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string")
    got = {r.id: r.u for r in rows.select("id", tx.unescape(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]
    assert got[len(texts)] is None
    plan = rows.select(tx.clean_news(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_dictionary_with_repeated_and_missing_keys(spark):
    d = Dictionary([("a", 1), ("a", 2), ("ü b", 3), ("", 4)], "v int")
    df = spark.createDataFrame([(["a", "x", "ü b", "", None],), ([],), (None,)], "ks array<string>")
    got = [r.v for r in df.select(F.transform(d.find_all(F.col("ks")), lambda e: e["v"]).alias("v")).collect()]
    assert got == [None, [], None] or got == [[1, 2, 3, 4], [], None]
    assert df.select(Dictionary([], "v int").find_all(F.col("ks")).alias("v")).where("size(v) > 0").count() == 0


def test_polarity_without_joins_equals_polarity_with_joins(spark, monkeypatch):
    rng = random.Random(5)
    words = "good bad fine never really awful the great poor".split()
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) + rng.choice(["", "!", "?", "s"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None)], "id long, t string")
    lexicon = spark.createDataFrame([("good", 0.7, 0.6), ("good", 0.1, 0.2), ("bad", -0.7, 0.7), ("awful", -1.0, 1.0), ("fine", 0.1, None), (None, 1.0, 1.0)], "word string, polarity double, subjectivity double").dropna()
    one = to.lexicon_scores(docs, "id", "t", lexicon)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in one._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((r.id, *(round(float(r[c]), 9) for c in sorted(df.columns) if c != "id")) for r in df.collect())
    inside = rows(one)
    monkeypatch.setattr(to, "SMALL_LOOKUP", 2)
    assert rows(to.lexicon_scores(docs, "id", "t", lexicon)) == inside


def test_terms_chosen_with_few_pairs_counted(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i:02d}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([4, 12, 30])]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["", None, "solo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    counts = Counter()
    for t in texts:
        ws = (t or "").split()
        counts.update(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    for k, limit in ((10, 10_000), (25, 10_000), (25, 3), (2000, 10_000)):
        monkeypatch.setattr(to, "SMALL_LOOKUP", limit)
        want = {t for t, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]}
        got = to.term_weights(docs, "id", "t", k, "count").collect()
        assert {r.term for r in got} == want
        assert sum(r.tf for r in got) == sum(counts[t] for t in want)


def test_terms_are_counted_without_splitting_texts_again(spark):
    """No text is read after the counts are written, and no pass filters by the size of its words first."""
    texts = ["red hot chili", "red hot", None, "", "chili red hot red hot", "the and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    out = to.term_weights(docs, "id", "t", 4)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.term): r.tf for r in out.collect()}
    assert got == {(0, "hot"): 1, (0, "red"): 1, (0, "red hot"): 1, (0, "chili"): 1, (1, "hot"): 1, (1, "red"): 1, (1, "red hot"): 1, (4, "chili"): 1, (4, "hot"): 2, (4, "red"): 2, (4, "red hot"): 2}
    rows = to._rows(docs.select("id", to.content_words(F.col("t")).alias("w")), F.col("w"), "id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
