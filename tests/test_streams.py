"""Streams in several batches with restarts against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketweave.operators.axis import Axis
from marketweave.operators.backtest import keep_positions
from marketweave.operators.risk import model_drift
from marketweave.session import new_shared_path
from marketweave.streaming import stateful, streams

DAY = datetime.datetime(2024, 3, 4)  # a Monday
TRADES = "symbol string, ts timestamp, id long, action string, quantity long, price double, error double"


def feed(spark, parts, schema, run):
    """Write the parts one after another to a folder and run the stream after each: a restart."""
    source = new_shared_path(spark, "feed")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = run(streams.file_stream(spark, source, spark.createDataFrame([], schema).schema))
    return out


@pytest.fixture(scope="module")
def trades():
    """One symbol has nine tenths of the rows; equal times; rows out of order inside the delay."""
    rng = random.Random(12)
    rows = []
    for i in range(600):
        symbol = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", "c"])
        at = DAY + datetime.timedelta(minutes=10 * (i // 2))
        rows.append((symbol, at, i, rng.choice(["BUY", "SELL", "SELL", "HOLD"]), rng.randint(0, 9), round(rng.uniform(5, 50), 2), rng.random() if i % 11 else None))
    for i in range(0, 598, 3):
        rows[i], rows[i + 2] = rows[i + 2], rows[i]
    return [rows[:150], rows[150:420], rows[420:]]


def closed(trades):
    top = max(r[1] for part in trades for r in part) - datetime.timedelta(hours=1)
    return [r for part in trades for r in part if r[1] <= top]


def test_position_book_over_three_batches(spark, trades):
    out, checkpoint = new_shared_path(spark, "out"), new_shared_path(spark, "checkpoint")
    got = feed(spark, trades, TRADES, lambda s: stateful.run_stateful(spark, stateful.stream_positions(s, "symbol", "ts", "id"), out, checkpoint))
    want = keep_positions(spark.createDataFrame(closed(trades), TRADES), ["symbol"], ["ts", "id"])
    names = ["symbol", "ts", "id", "action", "executed", "price", "position", "avg_price", "pnl", "is_short"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    assert len(rows(got)) == len(closed(trades)) and rows(got) == rows(want)
    assert any(r.is_short for r in want.collect()) and any(r.pnl < 0 for r in want.collect())


def test_drift_equals_the_batch_as_of_each_row(spark, trades):
    out, checkpoint = new_shared_path(spark, "out"), new_shared_path(spark, "checkpoint")
    stream = lambda s: stateful.stream_drift(s, "symbol", "ts", "id", "error", window=20, factor=1.1)
    got = {(r.symbol, r.rows): r for r in feed(spark, trades, TRADES, lambda s: stateful.run_stateful(spark, stream(s), out, checkpoint)).collect()}
    rows = closed(trades)
    assert len(got) == len(rows)
    axis = Axis(keys=("symbol",), order=("ts", "id"), bounded=True)
    near = lambda a, b: a is b is None or abs(a - b) < 1e-9
    seen = 0
    for upto in (40, 150, 333, len(rows)):
        first = sorted(rows, key=lambda r: (r[1], r[2]))[:upto]
        for want in model_drift(spark.createDataFrame(first, TRADES), axis, "error", 20, 1.1).collect():
            have = got[want.symbol, want.rows]
            assert all(near(have[c], want[c]) for c in ("recent_error", "historical_error", "last_10_error")) and (have.drift, have.high_error) == (want.drift, want.high_error)
            seen += want.drift
    assert seen


def test_flat_book_is_removed_and_starts_anew(spark):
    row = lambda minute, i, action, q: ("s", DAY + datetime.timedelta(minutes=minute), i, action, q, 10.0, 0.0)
    parts = [[row(0, 1, "BUY", 5), row(1, 2, "SELL", 5)], [row(3000, 3, "BUY", 0)], [row(6000, 4, "BUY", 2)], [row(9000, 5, "BUY", 1)]]
    out, checkpoint = new_shared_path(spark, "out"), new_shared_path(spark, "checkpoint")
    stream = lambda s: stateful.stream_positions(s, "symbol", "ts", "id", idle_ms=60_000)
    got = feed(spark, parts, TRADES, lambda s: stateful.run_stateful(spark, stream(s), out, checkpoint))
    assert sorted((r.id, r.position, r.avg_price) for r in got.collect()) == [(1, 5, 10.0), (2, 0, 0.0), (3, 0, 0.0), (4, 2, 10.0)]


def test_late_rows_are_counted_and_kept(spark):
    schema = "ts timestamp, id long"
    at = lambda minutes: DAY + datetime.timedelta(minutes=minutes)
    parts = [[(at(0), 1), (at(200), 2)], [(at(140), 3), (at(139), 4), (at(141), 5), (None, 6)], [(at(100), 7), (at(500), 8)], [(at(440), 9), (at(439), 10), (at(900), 11)]]
    out, counts, checkpoint = (new_shared_path(spark, x) for x in ("out", "counts", "checkpoint"))
    got = feed(spark, parts, schema, lambda s: streams.gated_sink(s, "ts", 3_600_000, out, counts, checkpoint)).collect()
    assert sorted((r.batch_id, r.rows, r.late) for r in got) == [(0, 2, 0), (1, 4, 2), (2, 2, 1), (3, 3, 2)]
    kept = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    assert {r.id for r in kept.where("late = 'true'").collect()} == {3, 4, 7, 9, 10} and kept.where("late = 'false'").count() == 6
    # the engine drops the same rows
    dropped = []

    def engine(stream):
        query = streams.unique_posts(stream, ["id"], "ts").writeStream.format("parquet").option("path", out + "-e").option("checkpointLocation", checkpoint + "-e").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped.append(sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]))

    feed(spark, [[r for r in part if r[0]] for part in parts], schema, engine)
    assert dropped == [0, 2, 1, 2]


def test_more_batches_than_progress_entries(spark):
    """Counts of all batches are there, also of those that a query's progress no longer lists."""
    source = new_shared_path(spark, "feed")
    rows = [(DAY + datetime.timedelta(hours=2 * (i if i % 2 else i - 1)), i) for i in range(1, 9)]
    for r in rows:
        spark.createDataFrame([r], "ts timestamp, id long").coalesce(1).write.mode("append").parquet(source)
    stream = streams.file_stream(spark, source, spark.createDataFrame([], "ts timestamp, id long").schema, files_per_batch=1)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    out, counts, checkpoint = (new_shared_path(spark, x) for x in ("out", "counts", "checkpoint"))
    got = streams.gated_sink(stream, "ts", 3_600_000, out, counts, checkpoint).collect()
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sum(r.rows for r in got) == 8 and len(got) == 8


def test_weeks_from_the_days_of_the_same_stream(spark):
    schema = "k string, ts timestamp, id long, price double"
    rows = [("x", DAY + datetime.timedelta(hours=5 * i), i, float((i * 7) % 11)) for i in range(140)]
    out, checkpoint = new_shared_path(spark, "out"), new_shared_path(spark, "checkpoint")
    weeks = feed(spark, [rows[:30], rows[30:70], rows[70:]], schema, lambda s: streams.run_available(streams.coarser_bars(s, ["k"], "ts", "id", "price"), out, checkpoint))
    days = feed(spark, [rows[:70], rows[70:]], schema, lambda s: streams.run_available(streams.stream_bars(s, ["k"], "ts", "id", "price"), out + "-d", checkpoint + "-d"))
    wanted = []
    for week in range(4):
        mine = [r for r in rows if DAY + datetime.timedelta(days=7 * week) <= r[1] < DAY + datetime.timedelta(days=7 * week + 7)]
        prices = [r[3] for r in mine]
        wanted.append((DAY + datetime.timedelta(days=7 * week), prices[0], max(prices), min(prices), prices[-1], len(mine), 7))
    assert sorted(tuple(r)[1:] for r in weeks.collect()) == wanted
    assert days.where(F.col("start") < DAY + datetime.timedelta(days=28)).agg(F.sum("volume")).first()[0] == sum(w[5] for w in wanted)


class _Kept:
    """Map and value state in memory."""

    def __init__(self, keys=None, schema=None):
        self.rows, self.one = {}, None

    keys = lambda self: iter(list(self.rows))
    getValue = lambda self, k: self.rows[k]
    updateValue = lambda self, k, v: self.rows.__setitem__(k, v)
    removeKey = lambda self, k: self.rows.pop(k)
    exists = lambda self: self.one is not None
    get = lambda self: self.one
    update = lambda self, v: setattr(self, "one", v)
    clear = lambda self: (self.rows.clear(), setattr(self, "one", None))


def test_a_hot_key_is_folded_slice_by_slice(monkeypatch):
    """Rows in any order over calls of many and of few rows: each fold sees one slice, results are those of one fold."""
    import types

    import pandas as pd

    monkeypatch.setattr(stateful, "ROWS_HELD", 50)
    monkeypatch.setattr(stateful, "ROWS_LOOSE", 20)
    rng, timers, sizes = random.Random(4), [], []
    p = stateful.ErrorDrift("k", "ts", "id", ("error",), window=20)
    handle = types.SimpleNamespace(getMapState=lambda n, k, v: _Kept(), getValueState=lambda n, s: _Kept(), registerTimer=timers.append)
    p.init(handle)
    fold = p.fold
    p.fold = lambda state, rows: (sizes.append(len(rows)), fold(state, rows))[1]
    rows = [(DAY + datetime.timedelta(minutes=3 * i), i, rng.random()) for i in range(900)]
    rng.shuffle(rows)
    calls = [rows[:600], rows[600:610], rows[610:]]
    got = []
    for n, call in enumerate(calls):
        frames = [pd.DataFrame(call[i : i + 30], columns=["ts", "id", "error"]) for i in range(0, len(call), 30)]
        assert list(p.handleInputRows(("x",), iter(frames), None)) == []
        if n < 2:  # nothing has passed yet: the rows wait on
            mark = pd.Timestamp(DAY).value // 10**6 - 1
            assert list(p.handleExpiredTimer(("x",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None)) == []
    for minutes in (1000, 1001, 9000):
        mark = pd.Timestamp(DAY + datetime.timedelta(minutes=minutes)).value // 10**6
        got += list(p.handleExpiredTimer(("x",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None))
    have = pd.concat(got)
    rows.sort()
    want = fold(p.fresh(), [r[1:] for r in rows])[1]
    assert have["id"].tolist() == [r[1] for r in rows] and have["rows"].tolist() == want["rows"]
    assert have["recent_error"].tolist() == pytest.approx(want["recent_error"]) and have["drift"].tolist() == want["drift"]
    assert max(sizes) <= 20 and not p.waiting.rows
