"""Personal data: patterns for direct identifiers and an information-theoretic test for the rest.

The patterns find the protected entities: addresses, IP addresses, payment cards, phone numbers.
A term that keeps company with an entity gives the entity away even where the entity itself is
masked. Over all documents, with N rows, n(e) rows holding entity e, n(t) holding term t and n(t,e)
holding both, the information content is IC(e) = log2(N / n(e)) and the term discloses PMI(t;e) / IC(e) of
it, PMI = log2(P(e|t) N / n(e)); 1 means that the term alone determines the entity. Every entity and
every term beside it is tested, also where they meet in one text only. P(e|t) is not the plain share
n(t,e) / n(t) but its lower Wilson bound (one-sided 90 %, ``z``) over different texts, so that exact
copies add no evidence: one meeting proves P >= 0.38, two 0.55, four 0.71. A term of a single text
therefore reaches ``generalise_at`` only in a corpus of enough rows (130 at 0.8). Within documents
that hold e, terms that disclose at least ``generalise_at`` are spans: generalised to their shape,
from ``remove_at`` on removed.

Entities that stand in the same texts have the same figures and are counted as one group (told
apart by 128 bits), so a list of many addresses does not multiply its words.

Edge cases: null is the empty text; empty texts have no spans; offsets are code points, end
exclusive; rows with equal id and text get equal results; other columns are ignored. Patterns are
matched in time linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import free_names, listed_spans, plain_texts, sha256, spool, text_digest, text_rows

KINDS = ("email", "ip", "card", "phone")
# fixed values: the patterns of the base kinds
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = re.compile(r"[^\W_]{3,}")
ROW = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "entities array<string>, terms array<struct<term:string,start:int,end:int>>"
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the run of its characters before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def _rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in plain_texts(batch.column(1)):
                spans = base_spans(text)
                terms = []
                if spans:
                    inside = [(a, b) for _, a, b in sorted(spans, key=lambda s: s[1])]
                    k = 0
                    for m in _TERM.finditer(text):
                        a, b = m.span()
                        while k < len(inside) and inside[k][1] <= a:
                            k += 1
                        if not any(x < b and a < y for x, y in inside[k : k + 4]):
                            terms.append({"term": m.group().lower(), "start": a, "end": b})
                n = Counter(kind for kind, _, _ in spans)
                listed = listed_spans(spans)
                found = sorted({entity(kind, text[a:b]) for kind, a, b in spans})
                rows.append((*(n[k] for k in KINDS), sha256(listed), listed, found, terms))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [pa.array(c, schema.field(i + 2).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], schema=schema)

    return run


def folded(text: str) -> set[str]:
    """The terms of a text, folded one by one as in the lists of _rows: some letters change their
    length or depend on their neighbours when a whole text is folded."""
    return {w.lower() for w in set(_TERM.findall(text))}


def _all_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    counts: Counter[str] = Counter()
    for batch in batches:
        for text in plain_texts(batch.column(0)):
            counts.update(folded(text))
            if len(counts) > 300_000:
                yield flush()
                counts.clear()
    yield flush()


def _document_frequencies(wanted):
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in plain_texts(batch.column(0)):
                counts.update(terms.intersection(folded(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return run


def term_frequencies(texts: DataFrame, terms: DataFrame, slice_terms: int = 1_000_000) -> DataFrame:
    """term, n: rows holding each wanted term. Up to ``slice_terms`` terms go to the workers, more of
    them are joined with the counts of all terms; either way is one pass over the texts."""
    if terms.count() > slice_terms:
        counts = texts.mapInArrow(_all_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return counts.join(terms, "term", "left_semi")
    wanted = texts.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.toLocalIterator()))
    return texts.mapInArrow(_document_frequencies(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosure(n: int, n_e, n_t, n_te, texts, z: float):
    """The share of IC(e) that a term gives away for certain; texts: different texts among n_te rows."""
    p = F.least(n_te / n_t, F.lit(1.0))
    m = texts / p
    bound = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    content = F.log2(F.lit(float(n)) / n_e)
    return F.when(content > 0, (F.log2(bound) + content) / content).otherwise(F.lit(0.0))


def disclosures(rows: DataFrame, texts: DataFrame, generalise_at: float, z: float) -> DataFrame:
    """digest, term, disclosure of the terms from ``generalise_at`` on in the texts that hold their entity."""
    n = rows.count()
    held = rows.where(F.size("entities") > 0)
    holds = held.select("digest", F.explode("entities").alias("entity")).groupBy("entity", "digest").agg(F.count(F.lit(1)).alias("k"))
    # fixed values: two seeds of the hash of a set of texts
    places = [F.bit_xor(F.xxhash64("digest", F.lit(seed))).alias(f"set{seed}") for seed in (1, 2)]
    sets = holds.groupBy("entity").agg(F.sum("k").alias("n_e"), *places)
    group = ["set1", "set2", "n_e"]
    members = spool(holds.join(sets, "entity").select("digest", *group).distinct(), "members")
    distinct = F.first(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("terms")
    met = held.groupBy("digest").agg(F.count(F.lit(1)).alias("k"), distinct).join(members, "digest").select("digest", *group, "k", F.explode("terms").alias("term"))
    pairs = met.groupBy(*group, "term").agg(F.sum("k").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    # a term stands in n_te rows at least: what is too weak even then needs no count
    pairs = spool(pairs.where(disclosure(n, F.col("n_e"), F.col("n_te"), F.col("n_te"), F.col("texts"), z) >= generalise_at), "pairs")
    frequency = term_frequencies(texts, pairs.select("term").distinct())
    share = disclosure(n, F.col("n_e"), F.col("n"), F.col("n_te"), F.col("texts"), z)
    shown = pairs.join(frequency, "term").withColumn("disclosure", share).where(F.col("disclosure") >= generalise_at)
    # a term goes only to the texts of its entity that hold it, so rows grow with the texts
    return met.select("digest", *group, "term").join(shown.select(*group, "term", "disclosure"), [*group, "term"]).groupBy("digest", "term").agg(F.max("disclosure").alias("disclosure"))


def personal_data(documents: DataFrame, generalise_at: float = 0.8, z: float = 1.2816) -> DataFrame:
    """Per document row: counts of the base kinds, digest and list of base spans, disclosing terms
    as array of (start, end, disclosure), and the digest of the text."""
    docs = text_rows(documents, "doc_id", "text", text_digest("text").alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = documents.sparkSession.createDataFrame([], f"doc_id {kind}, digest binary, {ROW}").schema
    rows = spool(docs.mapInArrow(_rows(to_arrow_schema(schema)), schema), "entities")
    shown = spool(disclosures(rows, docs.select("text"), generalise_at, z), "disclosures")
    held = rows.where(F.size("entities") > 0).select("doc_id", "digest", F.explode("terms").alias("t"))
    spans = (
        held.select("doc_id", "digest", "t.*").join(shown, ["digest", "term"])
        .groupBy("doc_id", "digest", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("shown"))
        .withColumnsRenamed({"doc_id": "s_id", "digest": "s_digest"})
    )
    out = rows.drop("entities", "terms").join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("digest") == F.col("s_digest")), "left")
    return out.drop("s_id", "s_digest")


def personal_data_report(documents: DataFrame) -> DataFrame:
    """The digest columns of personal_data(): the kind of a disclosing term is ``term``."""
    found = personal_data(documents)
    terms = F.transform("shown", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    listed = F.array_join(F.concat(F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>")), F.coalesce(terms, F.array().cast("array<string>"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.when(F.col("shown").isNull(), 0).otherwise(F.size("shown")).cast("long").alias("n_term"), "base_sha256", listed.alias("spans"))


def mask(text: str, base: str, shown, remove_at: float) -> str:
    """The text with entities masked by kind, terms generalised to their shape or removed."""
    spans = [(int(a), int(b), f"[{kind.upper()}]") for kind, a, b in (s.split(":") for s in base.split(",") if s)]
    for s in shown if shown is not None else ():
        word = text[s["start"] : s["end"]]
        shape = "[NUMBER]" if word.isdigit() else "[CODE]" if any(map(str.isdigit, word)) else "[NAME]" if word[0].isupper() else "[TERM]"
        spans.append((s["start"], s["end"], "" if s["disclosure"] >= remove_at else shape))
    out, at = [], 0
    for a, b, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitised(documents: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, z: float = 1.2816) -> DataFrame:
    """documents with the personal data of ``text`` masked, generalised or removed."""

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, shown: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or b is None else mask(t, b, s, remove_at) for t, b, s in zip(text, base, shown, strict=True)])

    found = personal_data(documents, generalise_at, z).where((F.col("base") != "") | F.col("shown").isNotNull())
    p_id, p_digest, base, shown = free_names(documents, "_p_id", "_p_digest", "_p_base", "_p_shown")
    found = found.withColumnsRenamed({"doc_id": p_id, "digest": p_digest, "base": base, "shown": shown})
    found = found.select(p_id, p_digest, base, shown).dropDuplicates([p_id, p_digest])
    key = text_digest("text")
    joined = documents.join(found, documents["doc_id"].eqNullSafe(F.col(p_id)) & (key == F.col(p_digest)), "left")
    return joined.withColumn("text", clean("text", base, shown)).select(*documents.columns)
