"""Rules of many strategies with missing values, strict fields, small point budgets, buy and hold, headlines and scored sweeps."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, rules, stats, sweep, verdicts

from .test_backtest import CROSS, series, walk

CLOSE, SMA = {"ind": "close"}, {"ind": "sma", "period": 99}
BASE = {"asset": "BTCUSDT", "timeframe": "1h", "side": "long"}


def entry(**groups):
    return BASE | {"entry": groups}


def test_conditions_with_missing_operands(spark):
    """A comparison with a value that a bar lacks is false, also as the only condition; a cross needs a bar before."""
    above = {"left": CLOSE, "op": ">", "right": 1}
    missing = {"left": {"ind": "rsi", "period": 14}, "op": "<", "right": SMA}
    cross = {"left": CLOSE, "op": "crosses_above", "right": 4}
    made = {"both": entry(all=[above, missing]), "alone": entry(all=[missing]), "some": entry(any=[missing, above]), "above": entry(all=[above]), "cross": entry(all=[cross])}
    rows = [("X", "1h", ts, "close", None, v, b) for ts, v, b in ((0, 5.0, None), (1, 3.0, 5.0), (2, 6.0, 3.0))]
    values = spark.createDataFrame(rows, "symbol string, interval string, ts long, ind string, period int, value double, before double")
    got = rules.eval_conditions(rules.parse_conditions(rules.strategy_rows(spark, made)), values).collect()
    hits = {(r.strategy_id, r.ts) for r in got if r.hit}
    assert len(got) == 15 and hits == {*(("some", t) for t in range(3)), *(("above", t) for t in range(3)), ("cross", 2)}


@pytest.mark.parametrize(
    ("where", "field"),
    [(lambda s: s, "x1"), (lambda s: s["claim"], "x2"), (lambda s: s["entry"], "x3"), (lambda s: s["entry"]["all"][0], "x4"), (lambda s: s["entry"]["all"][0]["left"], "x5"), (lambda s: s["exit"]["any"][0]["right"], "x6")],
)
def test_unknown_fields_at_every_level(spark, where, field):
    one = {"left": {"ind": "close"}, "op": "<", "right": {"ind": "sma", "period": 3}}
    s = json.loads(json.dumps(BASE | {"entry": {"all": [one]}, "exit": {"any": [one]}, "claim": {"win_rate_pct": 60, "quote": "q"}}))
    where(s)[field] = 1
    good = rules.parse_strategies(rules.strategy_rows(spark, {"a": s})).first().error
    assert good == f"unknown field {field}"
    del where(s)[field]
    assert rules.parse_strategies(rules.strategy_rows(spark, {"a": s})).first().error is None


@pytest.mark.parametrize("most", range(8))
def test_downsample_keeps_its_budget(spark, most):
    curve = spark.createDataFrame([("r", i, float((i * 7) % 11)) for i in range(40)], "run string, idx int, v double")
    got = sorted(r.idx for r in stats.downsample(curve, ["run"], "v", most).collect())
    assert len(got) <= max(most, 1) and got[0] == 0 and (most < 2 or got[-1] == 39)


def test_buy_and_hold_starts_at_the_first_open(spark):
    rows = [("r", 0, 0, 80.0, 100.0, 1.0), ("r", 1, 1, 100.0, 110.0, 1.0), ("r", 2, 2, 50.0, 120.0, 1.0), ("r", 3, 3, 120.0, 60.0, 1.0)]
    curve = spark.createDataFrame(rows, "run string, idx int, ts long, open double, close double, equity double")
    none = spark.createDataFrame([], "run string, trade_no int, entry_idx int, return_pct double")
    assert stats.return_stats(curve, ["run"]).first().buy_and_hold_pct == pytest.approx(100 * (60 / 80 - 1))
    parts = {r.part: r.buy_and_hold_pct for r in stats.split_stats(none, curve, ["run"], 0.5, F.lit(365)).collect()}
    assert parts == {"IS": pytest.approx(100 * (110 / 80 - 1)), "OOS": pytest.approx(100 * (60 / 50 - 1))}


def test_headlines(spark):
    rows = [(20, 5.0, 9.0, 1.5), (40, -1.0, 1.0, 0.8), (40, -0.1, 9.0, 0.9), (40, 2.0, 1.0, 1.5), (40, 0.1, 9.0, 1.05), (40, 2.0, 1.0, 1.1)]
    split = spark.createDataFrame([(i, p, n, 3.0 if p == "IS" and i == 5 else e, sd, pf, 1.0, 1.0, 1.0) for i, (n, e, sd, pf) in enumerate(rows) for p in ("IS", "OOS")], "run int, part string, trades long, expectancy_pct double, expectancy_stdev_pct double, profit_factor double, total_return_pct double, buy_and_hold_pct double, max_drawdown_pct double")
    got = {r.run: (r.grade, r.headline) for r in verdicts.verdicts(split, ["run"]).collect()}
    assert [got[i][0] for i in range(6)] == ["not_enough_data", "fails", "fails", "holds", "fragile", "fragile"]
    assert "there are 20" in got[0][1] and "lost money" in got[1][1] and "small average loss" in got[2][1] and "Held up" in got[3][1] and "small average gain" in got[4][1] and "too weak" in got[5][1]


def test_cross_market_reasons(spark):
    rows = [("a", "X", "holds"), ("a", "Y", "fails"), ("a", "Z", None), ("b", "X", "holds"), ("b", "Y", "holds"), ("c", "X", "holds")]
    got = {r.run: r for r in verdicts.cross_market(spark.createDataFrame(rows, "run string, symbol string, grade string"), ["run"]).collect()}
    assert (got["a"].grade, got["a"].unchecked, got["a"].reasons[:2]) == ("fails", ["Z"], ["Fails on Y.", "Could not be checked: Z."])
    assert (got["b"].grade, got["b"].reasons) == ("holds", ["Holds on 2 of 2 markets."]) and got["c"].grade == "not_enough_data"


@pytest.mark.parametrize("folds", [None, 3])
def test_sweep_figures_equal_the_statistics_of_single_runs(spark, folds):
    bars, year = series(spark, walk(700), "X", "Y"), 8760
    combos = sweep.grid_combos(spark, [("stop_loss_pct", [1.0, 3.0]), ("take_profit_pct", [2.0, 4.0])])
    got = sweep.sweep_stats(bars, CROSS, combos, year, split=0.7, folds=folds, batch=3)
    figures = {(r.symbol, r.trial_id, r.fold, r.part): r for r in got.collect()}
    assert len(figures) == 2 * 4 * 2 * (folds or 1)
    for trial in combos.where("trial_id in (0, 3)").collect():
        t = backtest.run_strategy(bars, sweep.applied(CROSS, trial["params"]))
        curve = backtest.equity_curve(bars, t)
        want = stats.split_stats(t, curve, ["symbol"], 0.7, F.lit(year)) if folds is None else stats.walk_forward_stats(t, curve, ["symbol"], folds, F.lit(year))
        for r in want.collect():
            own = figures[r.symbol, trial["trial_id"], r.asDict().get("fold", 0), r.part]
            for c in want.columns:
                if c not in ("symbol", "part", "fold"):
                    assert own[c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (c, r)
    ranked = sweep.sweep_results(got, combos, "sharpe").collect()
    for symbol in "XY":
        scores = [r.score for r in sorted((r for r in ranked if r.symbol == symbol), key=lambda r: r.rank)]
        assert len(scores) == 4 and scores == sorted(scores, reverse=True)
