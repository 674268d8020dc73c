"""Backtests of a table of strategies against single runs."""

import json

import pytest

from barloom.operators import backtest, batches, rules
from barloom.operators.backtest import TRADE_NAMES
from .test_timesplit import series, walk

IND = lambda k, n=None: {"ind": k} if n is None else {"ind": k, "period": n}
BOOK = {
    "cross": {"side": "long", "entry": {"all": [{"left": IND("close"), "op": "crosses_above", "right": IND("sma", 5)}]}, "exit": {"any": [{"left": IND("close"), "op": "crosses_below", "right": IND("ema", 7)}]}, "stop_loss_pct": 2},
    "dip": {"side": "short", "entry": {"all": [{"left": IND("rsi", 6), "op": ">", "right": 60}], "any": [{"left": IND("open"), "op": ">", "right": 101.5}, {"left": IND("close"), "op": "<", "right": IND("sma", 20)}]}, "take_profit_pct": 1.5},
    "never": {"side": "long", "entry": {"all": [{"left": IND("close"), "op": "<", "right": -1}]}, "claim": {"win_rate_pct": 50}},
    "always": {"side": "long", "entry": {"any": [{"left": IND("close"), "op": ">", "right": 0}]}, "exit": {"all": [{"left": IND("high"), "op": ">", "right": IND("close")}]}, "claim": {"win_rate_pct": 0}},
    "wrong": {"side": "long", "entry": {"all": [{"left": 1, "op": "<", "right": 2}]}},
}
BOOK = {k: {"asset": "A", "timeframe": "1m"} | v for k, v in BOOK.items()}


@pytest.fixture(scope="module")
def made(spark):
    texts = rules.strategy_rows(spark, BOOK)
    conditions = rules.parse_conditions(texts)
    return rules.validate_strategies(rules.parse_strategies(texts), conditions), conditions


@pytest.fixture(scope="module")
def candles(spark):
    return series(spark, A=walk(300, 1), B=walk(200, 2), C=walk(3, 3))


def asked(spark, extra=()):
    return spark.createDataFrame([(s, m, "1m") for s in BOOK for m in ("A", "B", "C", "NONE")] + list(extra), "strategy_id string, symbol string, interval string")


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_equals_single_runs(spark, made, candles, batch):
    strategies, conditions = made
    runs = asked(spark, [("cross", "A", "1m"), ("unknown", "A", "1m")])
    got = {}
    for r in batches.backtest_runs(candles, batches.programs(strategies, conditions), runs, batch=batch).collect():
        got.setdefault((r.strategy_id, r.symbol), []).append(tuple(r[c] for c in TRADE_NAMES))
    want = {}
    for name, s in BOOK.items():
        if name != "wrong":
            for r in backtest.run_strategy(candles, s).collect():
                want.setdefault((name, r.symbol), []).append(tuple(r[c] for c in TRADE_NAMES))
    assert sorted(got) == sorted(want) and len({k for k, _ in got}) == 3
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert [pytest.approx(x, rel=1e-9) if isinstance(x, float) else x for x in b] == list(a), k


def test_a_series_is_shared_by_its_batches_only(spark, made, candles):
    strategies, conditions = made
    runs = batches.own_runs(strategies)
    assert {(r.strategy_id, r.symbol, r.interval) for r in runs.collect()} == {(k, "A", "1m") for k in BOOK if k != "wrong"}
    trades = batches.backtest_runs(candles, batches.programs(strategies, conditions), runs)
    assert {r.symbol for r in trades.select("symbol").distinct().collect()} == {"A"}


def test_report_has_every_requested_run(spark, made, candles):
    strategies, conditions = made
    runs = asked(spark, [("unknown", "A", "1m")])
    trades = batches.backtest_runs(candles, batches.programs(strategies, conditions), runs)
    bad = spark.createDataFrame([("cross", "C", "1m", *[None] * 10, "equity used up")], trades.schema)
    report = batches.with_claims(batches.run_report(runs, strategies, candles, trades.unionByName(bad)), strategies)
    got = {(r.strategy_id, r.symbol): r for r in report.collect()}
    assert len(got) == len(BOOK) * 4 + 1
    assert got["unknown", "A"].status == got["wrong", "A"].status == "rejected" and got["wrong", "A"].reason == "compares two plain numbers"
    assert (got["cross", "NONE"].status, got["cross", "NONE"].reason, got["cross", "NONE"].trades) == ("unchecked", "no candles of NONE in 1m", None)
    assert (got["cross", "C"].status, got["cross", "C"].return_pct) == ("error", None)
    assert (got["never", "A"].status, got["never", "A"].trades, got["never", "A"].return_pct, got["never", "A"].held) == ("ok", 0, 0.0, None)
    assert got["always", "A"].held is True and got["always", "A"].bars == 300
    best = batches.best_runs(report, 2).collect()
    assert {(r.symbol, r["rank"]) for r in best} == {("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 1), ("C", 2)}
    assert not any(r.status != "ok" for r in best) and json.dumps([r.symbol for r in best])
