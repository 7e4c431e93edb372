"""Bars of large tables are dealt by key in tasks of bounded size, and windows keep that."""

from __future__ import annotations

import pytest

from marketweave import session
from marketweave.operators import backtest as bt
from marketweave.operators import series as s
from marketweave.operators import signals as sg
from marketweave.plans import q_trading, roles

DATA = "/root/testdata/sf0.001"


def test_tasks_of_windows_do_not_grow_with_the_table(spark, monkeypatch):
    want = s.macd(roles.bars(spark, DATA), roles.BAR_AXIS)
    names = [c for c in want.columns if c.startswith("macd")]
    small = {tuple(r) for r in want.select("key", "day", *names).collect()}
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    out = s.macd(roles.bars(spark, DATA), roles.BAR_AXIS)
    assert out.rdd.getNumPartitions() >= roles.most_bars(spark, DATA) / 500
    assert {tuple(r) for r in out.select("key", "day", *names).collect()} == small


def test_strategies_do_not_depend_on_the_dealing(spark, monkeypatch):
    few = q_trading.strategy_comparison(spark, DATA).collect()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    many = q_trading.strategy_comparison(spark, DATA).collect()
    assert len(many) == len(few) == 3
    for got, want in zip(sorted(many, key=lambda x: x["strategy"]), sorted(few, key=lambda x: x["strategy"]), strict=True):
        for c, value in want.asDict().items():
            # sums of floating point numbers in another order
            assert got[c] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), c


def test_signals_read_the_bars_once(spark):
    plan = q_trading.enhanced(spark, DATA)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("l_suppkey") and plan.split("== Optimized Logical Plan ==")[1].split("== Physical")[0].count("Relation [l_") == 1


def test_curves_of_backtests_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    path = bt.run_backtest(sg.adaptive_signal(q_trading.predictions(spark, DATA)), ["key"])
    rows = path.count()
    assert rows > 50 * 16
    plan = bt.performance(path, ["key"])._jdf.queryExecution().toString()
    assert "hashpartitioning(key#" in plan and f", {-(-rows // 50)})" in plan
