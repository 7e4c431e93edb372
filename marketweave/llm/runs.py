"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Every run of exponent two or more has a Lyndon root: for one of the two orders of the alphabet, the
longest Lyndon word that starts at some place of the run is as long as its period. Both Lyndon
arrays come directly from phase one of a grouping suffix sorter: suffixes start in groups by their
first word; groups are taken from the highest down; the nearest place to the left that lies in a
lower group puts the group's context behind its own, as often as members of the group point at it,
and moves into a new group just above its old one. What a suffix has gathered when its group is
taken is its longest Lyndon prefix. Each root is then extended to both sides by longest common
extensions of its place and the place one period on.

From an exponent of three on only stretches are looked at in which every three words in a row occur
often enough in the text: any run lies within one such stretch as a whole, so nothing is lost.

Work is per text, without a shuffle. Edge cases: null and empty texts have no words and no runs;
a very long text is one row of one task, with some 500 bytes for each word of its repetitive
stretches; ids may be null or repeat; an empty table gives an empty result; columns other than the
keys and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketweave.llm.common import byte_texts, text_rows

Run = tuple[int, int, int]  # start, length, period


def lyndon_lengths(ranks: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping."""
    n = len(ranks)
    letters = sorted(set(ranks))
    number = {r: g for g, r in enumerate(letters)}
    group = [number[r] for r in ranks]
    members: list[set[int]] = [set() for _ in letters]
    for i, g in enumerate(group):
        members[g].add(i)
    context = [1] * len(letters)
    # groups form a list from low to high; a number says nothing of a later group's place in it
    below, above = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    # waiting[i + 1] leads to the nearest place up to i whose group has not been taken; 0: none
    waiting = list(range(n + 1))
    g = len(letters) - 1
    while g >= 0:
        taken = members[g]
        for i in taken:
            waiting[i + 1] = i
        pointed: dict[int, int] = {}
        for i in taken:
            at = i
            while (to := waiting[at]) != at:
                waiting[at] = at = waiting[to]
            if at:
                pointed[at - 1] = pointed.get(at - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((times, group[j]), []).append(j)
        # more repetitions of the context rank higher, so they go first to the place above
        for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            places, new, over = moves[times, old], len(members), above[old]
            members.append(set(places))
            members[old].difference_update(places)
            context.append(context[old] + times * context[g])
            below.append(old)
            above.append(over)
            below[over] = above[old] = new
            for j in places:
                group[j] = new
        g = below[g]
    return [context[g] for g in group]


def _equal_ahead(s: np.ndarray, a: int, b: int) -> int:
    """Longest common extension of the places a < b, in blocks of growing size."""
    done, size = 0, 16
    while b + done < len(s):
        far = s[b + done : b + done + size]
        differ = far != s[a + done : a + done + len(far)]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + len(far), 2 * size
    return done


def find_runs(s: np.ndarray, min_length: int, min_exponent: float) -> list[Run]:
    """All runs of a sequence of whole numbers, by start, then period."""
    n, found = len(s), set()
    back = s[::-1]
    for ranks in (s, -s):
        lengths = np.array(lyndon_lengths(ranks.tolist()), dtype=np.int64)
        at = np.flatnonzero(lengths * min_exponent <= n)
        p = lengths[at]
        at, p = at[at + p < n], p[at + p < n]
        if min_exponent >= 3:  # two whole roots follow one another
            near = at + p
            roots = (lengths[near] == p) & (near + p <= n)
            at, p, near = at[roots], p[roots], near[roots]
            same = (s[at] == s[near]) & (s[near - 1] == s[near + p - 1]) & (s[at + p // 2] == s[near + p // 2])
            at, p = at[same], p[same]
        seen: dict[int, int] = {}  # period: end of the last stretch extended
        for i, q in zip(at.tolist(), p.tolist(), strict=True):
            if i + q < seen.get(q, 0):
                continue
            end = i + q + _equal_ahead(s, i, i + q)
            start = i - _equal_ahead(back, n - i - q, n - i)
            seen[q] = end
            if end - start >= max(min_length, min_exponent * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive_stretches(s: np.ndarray, min_length: int, min_exponent: float) -> list[tuple[int, int]]:
    """Places between which all runs lie, each run in one of them."""
    n = len(s)
    if n < max(min_length, min_exponent):
        return []
    # of a run's triples each occurs this often in the run
    often = min(max(min_length, math.ceil(min_exponent)) - 2, math.floor(min_exponent) - 1)
    if often < 2:
        return [(0, n)]
    u = s.astype(np.uint64)
    triples = (u[:-2] << np.uint64(42)) ^ (u[1:-1] << np.uint64(21)) ^ u[2:]
    _, which, count = np.unique(triples, return_inverse=True, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], count[which] >= often, [0]))))
    return [(a, b + 2) for a, b in edges.reshape(-1, 2).tolist() if b + 2 - a >= max(min_length, min_exponent)]


def word_runs(words: Sequence[bytes], min_length: int, min_exponent: float) -> list[Run]:
    numbers: dict[bytes, int] = {}
    s = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    return [(a + start, length, q) for a, b in repetitive_stretches(s, min_length, min_exponent) for start, length, q in find_runs(s[a:b], min_length, min_exponent)]


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    if not runs:
        return list(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(documents: DataFrame, keys: Sequence[str] = ("doc_id",), text: str | Column = "text", min_length: int = 6, min_exponent: float = 4) -> DataFrame:
    """Per row the keys, n_words, the runs (start and length in words, period) by start, then
    period, and the text without the repetitions, its words joined by one blank."""
    rows = text_rows(documents, *keys, (F.col(text) if isinstance(text, str) else text).alias("__text"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = documents.sparkSession.createDataFrame([], f"{kinds}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").schema
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, texts = [], [], []
            for value in byte_texts(batch.column(len(keys))):
                words = value.split()  # bytes part at the six ASCII blanks only
                runs = word_runs(words, min_length, min_exponent)
                sizes.append(len(words))
                found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode())
            columns = [sizes, found, texts]
            arrays = [pa.array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *arrays], schema=arrow)

    return rows.mapInArrow(scan, schema)


def with_periodic_tails(doc_id: str, text: str) -> Column:
    """The text, for a tenth of the ids with its end replaced by repetitions of an earlier part:
    h is the crc32 of the id, g = floor(h / 10); if 10 divides h, word i >= a = g % n becomes word
    a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    size = F.size(words)
    a = (g % size).cast("int")
    period = (1 + F.floor((size - a) / (3 + g % 8))).cast("int")
    parts = F.named_struct(F.lit("w"), words, F.lit("n"), size, F.lit("a"), a, F.lit("p"), period)
    turned = F.transform(
        F.array(parts),
        lambda r: F.array_join(F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda i: F.get(r["w"], F.when(i < r["a"], i).otherwise(r["a"] + (i - r["a"]) % r["p"]))), " "),
    )
    return F.when((h % 10 == 0) & (size > 0), F.get(turned, F.lit(0))).otherwise(F.col(text))


def run_report(documents: DataFrame) -> DataFrame:
    """Counts, the longest run and the digests per document, over texts with periodic tails."""
    out = periodic_runs(documents, ("doc_id",), with_periodic_tails("doc_id", "text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("__best", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.start")).alias("start"),
        F.col("__best.length").alias("length"),
        (-F.col("__best.period")).alias("period"),
        F.floor(F.col("__best.length") * -1000 / F.col("__best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
