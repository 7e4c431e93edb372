"""Secret scans: patterns for assignments and keys, and a token-efficiency test for random strings.

The patterns give the base spans. The test looks at every run of key-like characters and compares
its length with its number of tokens under a public byte-level vocabulary: written language needs
few tokens for many characters, a random string many. Runs below ``max_chars_per_token`` are
``random`` spans. A run that is not is cut at / and =, then at dots, then at + _ -, and its pieces
are judged alike, so that a path does not cover the key in it; what stands beside a base span in the
same run is judged, too. Short pieces and pieces that look like words (letters of one case) must
be below a smaller ratio, see ``limit``; less than 12 characters are not judged. Known digests (32,
40, 56, 64, 96 or 128 hexadecimal digits), UUIDs, numbers, dates and addresses are no spans.

Edge cases: null is the empty text; empty texts have no spans; offsets are code points, end
exclusive; rows with equal ids are scanned one by one; other columns are ignored. Work per row is
linear in its text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import listed_spans, plain_texts, sha256, text_rows

# fixed values: the patterns of the base kinds
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
# fixed values: what a random-looking run may be instead of a secret
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z"
    r"|[0-9.,:_/=+-]+\Z",
    re.IGNORECASE | re.ASCII,
)
# fixed values: digests and UUIDs inside a longer run
INSIDE = re.compile(
    r"(?<![0-9a-z])(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{128}|[0-9a-f]{96}|[0-9a-f]{64}|[0-9a-f]{56}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9a-z])",
    re.IGNORECASE | re.ASCII,
)
LEAST = 12
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
# fixed values: where a run is cut, step by step
CUTS = tuple(re.compile(c) for c in (r"[^/=]+", r"[^/=.]+", r"[A-Za-z0-9]+"))
# fixed values: the two sides of an e-mail address
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BLOCK = 4096  # characters that are encoded at once
RESULT = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The public byte-level vocabulary; path is a rank file, by default the installed one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(run: str) -> bool:
    digits = sum(map(str.isdigit, run))
    upper = sum(map(str.isupper, run))
    lower = sum(map(str.islower, run))
    return (digits >= 3 and upper + lower >= 3) or (upper >= 3 and lower >= 3 and digits >= 1)


def limit(run: str) -> float:
    """Share of ``max_chars_per_token`` that a run must stay below; 0 for runs that are not judged.
    Long words and rare syllables of any language come near the ratio of short random strings."""
    pieces = CUTS[-1].findall(run)
    size = sum(map(len, pieces))
    if size < LEAST or len(pieces) > 1 and (len(run) < 16 or size < 5 * len(pieces) and not _mixed(run)):
        return 0.0
    if not all(p.isalpha() and (p.isupper() or p[1:].islower()) for p in pieces):
        return 1.0 if len(run) >= 16 else 0.9
    if len(pieces) > 1:
        return 0.75
    if run.isupper():
        return 1.0 if size >= 16 else 0.8
    return 0.95 if size >= 20 else 0.8 if size >= 16 else 0.75


def random_pieces(text: str, a: int, b: int, encode, max_chars_per_token: float, step: int = 0) -> Iterator[tuple[str, int, int]]:
    while b > a and text[b - 1] in ".=-_/+":
        b -= 1
    run = text[a:b]
    if b - a < LEAST or KNOWN.match(run):
        return
    share = limit(run)
    if share and (b - a) / sum(len(encode(run[i : i + BLOCK])) for i in range(0, b - a, BLOCK)) < share * max_chars_per_token:
        yield "random", a, b
        return
    for k in range(step, len(CUTS)):
        parts = [m.span() for m in CUTS[k].finditer(text, a, b)]
        if parts != [(a, b)]:
            for x, y in parts:
                yield from random_pieces(text, x, y, encode, max_chars_per_token, k + 1)
            return


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans of e-mail addresses. What stands between a colon and @ is a password, after mailto: a name."""
    found, at = [], text.find("@")
    back = text[::-1] if at >= 0 else ""
    while at >= 0:
        name, domain = LOCAL.match(back, len(text) - at), DOMAIN.match(text, at + 1)
        if name and domain:
            start = at - (name.end() - name.start())
            if text[start - 1 : start] != ":" or text[max(start - 7, 0) : start].lower() == "mailto:":
                found.append((start, domain.end()))
        at = text.find("@", at + 1)
    return found


def random_spans(text: str, base: list[tuple[str, int, int]], encode, max_chars_per_token: float) -> list[tuple[str, int, int]]:
    found, k = [], 0
    mails, e = addresses(text), 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][2] <= a:
            k += 1
        while e < len(mails) and mails[e][1] <= a:
            e += 1
        taken, j = [u.span() for u in INSIDE.finditer(text, a, b)] + [u for u in mails[e : e + 2] if u[0] < b], k
        while j < len(base) and base[j][1] < b:
            taken.append(base[j][1:])
            j += 1
        for x, y in sorted(taken):
            if x > a:
                found.extend(random_pieces(text, a, x, encode, max_chars_per_token))
            a = max(a, y)
        found.extend(random_pieces(text, a, b, encode, max_chars_per_token))
    return found


def _scan(path: str | None, max_chars_per_token: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            rows = []
            for text in plain_texts(batch.column(1)):
                base = base_spans(text)
                spans = base + random_spans(text, base, encode, max_chars_per_token)
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                n = {k: sum(s[0] == k for s in spans) for k in KINDS}
                rows.append((n["assign"], n["access"], n["hex"], n["random"], sha256(listed_spans(base)), listed_spans(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return run


def secret_report(documents: DataFrame, vocabulary: str | None = None, max_chars_per_token: float = 2.0) -> DataFrame:
    """Per document row: counts by kind, the digest of the base spans and all spans in order of start."""
    docs = text_rows(documents, "doc_id", "text")
    schema = documents.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}").schema
    return docs.mapInArrow(_scan(vocabulary, max_chars_per_token, to_arrow_schema(schema)), schema)


def redact(text: str, encode, max_chars_per_token: float = 2.0) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base = base_spans(text)
    spans = sorted(base + random_spans(text, base, encode, max_chars_per_token), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, vocabulary: str | None = None, max_chars_per_token: float = 2.0) -> DataFrame:
    """documents with the secrets of ``text`` replaced; all other columns and null texts stay."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return texts.map(lambda t: None if t is None else redact(t, encode, max_chars_per_token))

    return text_rows(documents, "*").withColumn("text", clean("text"))
