"""Exact quantiles with a bounded amount of memory per task.

``percentile`` keeps every distinct value in one task, so it is used only when few rows are left.
Otherwise the rows of all columns are counted in bins of equal width, and only the bins that hold a
wanted rank are divided again. A round is one aggregate over all columns with one row per bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.num import nan_to_null
from marketweave.session import cut

EXACT_ROWS = 200_000
#: Bins of one round, over all columns: what the driver reads.
BINS = 32_768


def column_ends(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Per column the rows with a value, how many of them are infinite (``below``, ``above``), the ends of
    the finite ones and the mean, in one pass."""
    aggs = []
    for c in dict.fromkeys(cols):
        x = nan_to_null(c)
        finite = F.when(F.abs(x) != math.inf, x)
        aggs.append(
            F.struct(
                F.count(x).alias("n"), F.count_if(x == -math.inf).alias("below"), F.count_if(x == math.inf).alias("above"),
                F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.avg(x).alias("mean"),
            ).alias(c)
        )
    return {c: e.asDict() for c, e in df.agg(*aggs).first().asDict().items()} if aggs else {}


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = EXACT_ROWS, ends: dict[str, dict] | None = None
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column (null and NaN ignored) as driver scalars. ``ends``: what
    ``column_ends`` has found already."""
    cols, probs = list(dict.fromkeys(cols)), list(probs)
    ends = column_ends(df, cols) if ends is None else ends
    df = df.select(*[nan_to_null(c).alias(c) for c in cols])
    small = [c for c in cols if ends[c]["n"] <= limit]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(
            *[F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs])).alias(c) for c in small]
        ).first()
        for c in small:
            out[c] = list(row[c]) if row[c] is not None else [None] * len(probs)
    large = [c for c in cols if c not in out]
    if large:
        at = {c: [p * (ends[c]["n"] - 1) for p in probs] for c in large}
        ranks = {c: sorted({k for a in at[c] for k in (math.floor(a), math.ceil(a))}) for c in large}
        found = _values_at(df.select(*large), large, ends, ranks, limit)
        for c in large:
            out[c] = [_between(found[c], a) for a in at[c]]
    return out


def _between(found: dict[int, float], at: float) -> float:
    a, b = found[math.floor(at)], found[math.ceil(at)]
    return a if a == b else a + (b - a) * (at - math.floor(at))


def _constant(values: Sequence, kind: str) -> Column:
    """An array that is one literal in the plan, however long it is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _values_at(df: DataFrame, cols: Sequence[str], ends: dict[str, dict], ranks: dict[str, list[int]], limit: int) -> dict[str, dict[int, float]]:
    """Column -> rank -> value at that rank of the sorted column."""
    inf = math.inf
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    # ranges that are searched: (column, lowest value, highest value, rows below, ranks)
    slots = []
    for c in cols:
        e = ends[c]
        found[c].update({k: -inf for k in ranks[c] if k < e["below"]})
        found[c].update({k: inf for k in ranks[c] if k >= e["n"] - e["above"]})
        slots.append((c, e["lo"], e["hi"], e["below"], [k for k in ranks[c] if k not in found[c]]))
    slots = [s for s in slots if s[4]]
    if not slots:
        return found
    rows, bins = _first_bins(df, slots)
    while slots:
        by_slot: dict[int, list] = {}
        for row in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # at most a row per bin
            by_slot.setdefault(row["k"] // bins, []).append(row)
        left, size, to = [], 0, [-1] * (bins * len(slots))
        for i, (c, _, _, below, wanted) in enumerate(slots):
            for row in sorted(by_slot[i], key=lambda r: r["k"]):
                here = [k for k in wanted if below <= k < below + row["n"]]
                known = {k: row["lo"] if row["lo"] == row["hi"] or k == below else row["hi"] for k in here if row["lo"] == row["hi"] or k in (below, below + row["n"] - 1)}
                found[c].update(known)
                if len(known) < len(here):
                    to[row["k"]] = len(left)
                    left.append((c, row["lo"], row["hi"], below, [k for k in here if k not in known]))
                    size += row["n"]
                below += row["n"]
        slots = left
        if slots:
            rows = rows.select(F.get(_constant(to, "int"), F.col("k")).alias("s"), "v").filter(F.col("s") >= 0)
            if size <= limit:
                for c, values in _settled(rows, slots):
                    found[c].update(values)
                break
            rows, bins = _binned(cut(rows), slots)
    return found


def _scales(slots: Sequence[tuple]) -> tuple[int, list[tuple[float, float, float]]]:
    """The bins of a range, and unit, lowest value and width of each. The lowest and the highest value
    of a range never share a bin, so each round divides it."""
    # a range wider than the largest number is measured in quarters
    units = [1.0 if math.isfinite(hi - lo) else 0.25 for _, lo, hi, _, _ in slots]
    return max(16, BINS // len(slots)), [(u, lo * u, (hi * u - lo * u) or 1.0) for u, (_, lo, hi, _, _) in zip(units, slots)]


def _bin(v: Column, unit, low, width, bins: int) -> Column:
    return F.least(F.floor((v * unit - low) / width * bins), F.lit(bins - 1)).cast("int")


def _first_bins(df: DataFrame, slots: Sequence[tuple]) -> tuple[DataFrame, int]:
    """Rows (v, k) with the number of their bin among those of all ranges: one range per column."""
    bins, scales = _scales(slots)
    pairs = []
    for i, ((c, *_), (unit, low, width)) in enumerate(zip(slots, scales)):
        v = F.col(c)
        finite = F.abs(v) != math.inf
        pairs.append(F.struct(v.alias("v"), F.when(finite, _bin(v, F.lit(unit), F.lit(low), F.lit(width), bins) + i * bins).alias("k")))
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").filter(F.col("k").isNotNull()), bins


def _binned(rows: DataFrame, slots: Sequence[tuple]) -> tuple[DataFrame, int]:
    """The same for rows (s, v) of any number of ranges s."""
    bins, scales = _scales(slots)
    of = lambda i: F.get(_constant([x[i] for x in scales], "double"), F.col("s"))
    return rows.select("v", (F.col("s") * bins + _bin(F.col("v"), of(0), of(1), of(2), bins)).alias("k")), bins


def _settled(rows: DataFrame, slots: Sequence[tuple]):
    """(column, rank -> value) of ranges that hold few rows together."""
    values: dict[int, list] = {}
    for row in rows.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `limit` rows
        values.setdefault(row["s"], []).append((row["v"], row["n"]))
    for i, (c, _, _, below, wanted) in enumerate(slots):
        found = {}
        for v, n in sorted(values[i]):
            found.update({k: v for k in wanted if below <= k < below + n})
            below += n
        yield c, found
