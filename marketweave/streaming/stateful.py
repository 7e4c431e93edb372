"""Typed state per key over rows in the order of their event time.

Rows of a key wait in map state until the watermark has passed them, many rows of one slice of time
in one typed entry, so a hot key is read slice by slice; a timer of the key then takes
the rows that are complete, in the order of time and tie, through a fold whose result is the key's
value state. Results therefore depend neither on the order of arrival nor on how the rows fall into
micro-batches, and a restart goes on from the checkpoint. A key that had no rows for ``idle_ms`` of
event time, and whose state equals a fresh one, is removed.

A fold is sequential by nature, so one key is one task; what that task holds is limited by
``ROWS_HELD`` rows on arrival and by the rows of the key in one slice in the fold, besides the calls of
few rows that wait unsliced. Checkpoints of the earlier list state cannot be continued.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketweave.operators.backtest import follow_book
from marketweave.operators.risk import drift_flags
from marketweave.streaming.streams import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Rows of a key that one call holds, rows of a call that are not worth slices, and the time of a slice.
ROWS_HELD, ROWS_LOOSE, SLICE_US, LOOSE = 200_000, 10_000, 3_600_000_000, -(2**62)


class OrderedFold(StatefulProcessor):
    """Base of the folds: ``state`` and ``carried`` describe a row of the state and of the input."""

    state = ""
    carried = ""

    def __init__(self, key: str, ts: str, tie: str, columns: tuple[str, ...], idle_ms: int = 30 * DAY_MS):
        self.key, self.ts, self.tie, self.columns, self.idle_ms = key, ts, tie, columns, idle_ms

    def fresh(self) -> tuple:
        raise NotImplementedError

    def fold(self, state: tuple, rows: list[tuple]) -> tuple[tuple, dict[str, list]]:
        """The state after the rows (tie, *columns), and the result columns, one entry per row."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in self.carried.split(", ")))
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, part long", f"at array<long>, tie array<long>, {kinds}")
        self.value = handle.getValueState("value", self.state)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, held, size, part = None, [], 0, 1 + max((k[1] for k in self.waiting.keys()), default=-1)
        for pdf in rows:
            at = pdf[self.ts].to_numpy("datetime64[us]").astype(np.int64).tolist()
            cells = [[None if v is None or v != v else v for v in pdf[c].tolist()] for c in self.columns]
            held.append([at, pdf[self.tie].tolist(), *cells])
            first, size = min(at) if first is None else min(first, min(at)), size + len(at)
            if size >= ROWS_HELD:
                self._keep(held, part, sliced=True)
                held, size, part = [], 0, part + 1
        if held:
            self._keep(held, part, sliced=size > ROWS_LOOSE)
        self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def _keep(self, held: list[list[list]], part: int, sliced: bool) -> None:
        rows = [list(chain.from_iterable(column)) for column in zip(*held)]
        if not sliced:
            self.waiting.updateValue((LOOSE, part), tuple(rows))
            return
        at = np.array(rows[0]) // SLICE_US
        order = np.argsort(at, kind="stable")
        for where in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            self.waiting.updateValue((int(at[where[0]]), part), tuple([column[i] for i in where] for column in rows))

    def _rows(self, keys: list[tuple]) -> list[tuple]:
        return [row for k in keys for row in zip(*self.waiting.getValue(k))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts: dict[int, list[tuple]] = {}
        for k in self.waiting.keys():
            parts.setdefault(k[0], []).append(tuple(k))
        part = 1 + max((k[1] for keys in parts.values() for k in keys), default=-1)
        loose = sorted(self._rows(parts.get(LOOSE, [])), key=lambda row: row[:2])
        due = sorted(n for n in parts if n != LOOSE and n * SLICE_US <= passed)
        later = [n for n in parts if n != LOOSE and n * SLICE_US > passed]
        state = at = None
        left: list[tuple] = []
        # without slices all rows are one group; else a group ends with its slice
        for n in due or [LOOSE]:
            end = passed if n in (LOOSE, *due[-1:]) else min((n + 1) * SLICE_US - 1, passed)
            mine = bisect_right(loose, end, key=lambda row: row[0])
            held = sorted([*loose[:mine], *self._rows(parts[n] if n != LOOSE else [])], key=lambda row: row[:2])
            loose, cut = loose[mine:], bisect_right(held, end, key=lambda row: row[0])
            left = held[cut:]
            if cut:
                state = state or (tuple(self.value.get()) if self.value.exists() else self.fresh())
                state, out = self.fold(state, [row[1:] for row in held[:cut]])
                at = held[cut - 1][0]
                yield pd.DataFrame({self.key: [key[0]] * cut, self.ts: pd.to_datetime([r[0] for r in held[:cut]], unit="us", utc=True), self.tie: [r[1] for r in held[:cut]], **out})
        if at is not None:
            self.value.update(state)
            self.last.update((at,))
        if not later:
            self.waiting.clear()
        else:
            for k in (k for n in (LOOSE, *due) for k in parts.get(n, [])):
                self.waiting.removeKey(k)
        for n, rows in ((LOOSE, loose), (due[-1] if due else LOOSE, left)):
            if rows:
                self.waiting.updateValue((n, part), tuple(map(list, zip(*rows))))
                part += 1
        ahead = [rows[0][0] for rows in (loose, left) if rows] + [n * SLICE_US for n in later]
        if ahead:
            self.handle.registerTimer(-(-min(ahead) // 1000))
        elif at is not None or self.last.exists():
            ends = (self.last.get()[0] if at is None else at) // 1000 + self.idle_ms
            if ends > passed // 1000:
                self.handle.registerTimer(ends)
            elif (tuple(self.value.get()) if state is None and self.value.exists() else state or self.fresh()) == self.fresh():
                self.value.clear()
                self.last.clear()

    def close(self) -> None:
        pass


class PositionBook(OrderedFold):
    """Average-cost book per symbol: the state is what is held and its average price."""

    state = "held long, price double"
    carried = "action string, quantity long, price double"
    result = "executed long, position long, avg_price double, pnl double, is_short boolean"

    def fresh(self) -> tuple:
        return (0, 0.0)

    def fold(self, state, rows):
        state, book = follow_book(state, ((action, quantity, price) for _, action, quantity, price in rows))
        names = ("executed", "position", "avg_price", "pnl", "is_short")
        return state, {"action": [r[1] for r in rows], "price": [r[3] for r in rows], **dict(zip(names, map(list, zip(*book)), strict=True))}


class ErrorDrift(OrderedFold):
    """Mean error of the last rows of a model against all rows before them: a ring of the last
    errors, and count and sum of what has left it."""

    state = "rows long, older long, older_sum double, ring array<double>"
    carried = "error double"
    result = "rows long, recent_error double, historical_error double, last_10_error double, drift int, high_error int"

    def __init__(self, *args, window: int = 100, factor: float = 1.5, **kwargs):
        super().__init__(*args, **kwargs)
        self.window, self.factor = window, factor

    def fresh(self) -> tuple:
        return (0, 0, 0.0, [])

    def fold(self, state, rows):
        count, older, older_sum, ring = state
        x = np.array([math.nan if v is None else v for v in (*ring, *(r[1] for r in rows))], dtype=float)
        known = ~np.isnan(x)
        total = np.concatenate(([0.0], np.cumsum(np.where(known, x, 0.0))))
        numbers = np.concatenate(([0], np.cumsum(known)))
        end = np.arange(len(ring), len(x)) + 1

        def mean(a, b, n=0, s=0.0):
            size = numbers[b] - numbers[a] + n
            return np.where(size > 0, (total[b] - total[a] + s) / np.maximum(size, 1), math.nan)

        start = np.maximum(end - self.window, 0)
        recent, history, last = mean(start, end), mean(np.zeros_like(end), start, older, older_sum), mean(np.maximum(end - 10, 0), end)
        seen = count + np.arange(1, len(rows) + 1)
        drift, high = drift_flags(seen, recent, history, last, self.factor)
        left = int(start[-1])
        kept = [None if math.isnan(v) else float(v) for v in x[left:]]
        state = (int(seen[-1]), int(older + numbers[left]), float(older_sum + total[left]), kept)
        means = {n: [None if math.isnan(v) else float(v) for v in m] for n, m in (("recent_error", recent), ("historical_error", history), ("last_10_error", last))}
        return state, {"rows": seen.tolist(), **means, "drift": drift.tolist(), "high_error": high.tolist()}


def _folded(stream: DataFrame, processor: OrderedFold, delay: str, more: str = "") -> DataFrame:
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (processor.key, processor.ts)}
    rows = stream.select(processor.key, processor.ts, F.col(processor.tie).cast("long").alias(processor.tie), *processor.columns).withWatermark(processor.ts, delay)
    schema = f"{processor.key} {kinds[processor.key]}, {processor.ts} timestamp, {processor.tie} long, {more}{processor.result}"
    return rows.groupBy(processor.key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_positions(trades: DataFrame, key: str, ts: str, tie: str, delay: str = "1 hour", idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """The book after each trade (action, quantity, price): the stream of ``keep_positions``."""
    typed = trades.withColumns({"quantity": F.col("quantity").cast("long"), "price": F.col("price").cast("double")})
    return _folded(typed, PositionBook(key, ts, tie, ("action", "quantity", "price"), idle_ms), delay, "action string, price double, ")


def stream_drift(errors: DataFrame, key: str, ts: str, tie: str, error: str, delay: str = "1 hour", window: int = 100, factor: float = 1.5, idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """``model_drift`` as of each row; rows with ``drift`` or ``high_error`` are the alerts."""
    typed = errors.withColumn("error", F.col(error).cast("double"))
    return _folded(typed, ErrorDrift(key, ts, tie, ("error",), idle_ms, window=window, factor=factor), delay)


def run_stateful(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """``run_available`` with the state store that typed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        return run_available(stream, out, checkpoint)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
