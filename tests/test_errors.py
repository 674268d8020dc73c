"""Runs that end in an error: they have no figures, no rank and no grade, and each fold is scored by itself."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, stats, sweep, verdicts
from .test_timesplit import M, series

RUINED = {"asset": "A", "timeframe": "1m", "side": "short", "entry": {"all": [{"left": {"ind": "close"}, "op": "<", "right": 1000}]}, "exit": {"any": [{"left": {"ind": "close"}, "op": ">", "right": 10_000}]}}


def jump():
    """Prices that fall a little, rise fivefold within a trade, and come back for a next entry."""
    close = [100.0] * 3 + [99.0] * 20 + [500.0, 20_000.0] + [2000.0, 100.0] * 10
    return pd.DataFrame([(i * M, c, c, c, c) for i, c in enumerate(close)], columns=["ts", "open", "high", "low", "close"])


def test_a_ruined_trial_is_never_ranked(spark):
    bars = series(spark, A=jump())
    combos = sweep.grid_combos(spark, [("entry.all.0.right", [1000.0, 1.0])])  # the second never trades
    figures = sweep.sweep_stats(bars, RUINED, combos, 8760)
    assert {(r.trial_id, r.error) for r in figures.collect()} == {(0, "equity used up"), (1, None)}
    assert all(r.trades is None and r.sharpe is None for r in figures.where("trial_id = 0").collect()) and figures.where("trial_id = 0").count() == 2
    for by in ("sharpe", "expectancy", "total_return", "profit_factor"):
        rows = {r.trial_id: r for r in sweep.sweep_results(figures, combos, by).collect()}
        assert (rows[0].status, rows[0].error, rows[0]["rank"], rows[0].score) == ("error", "equity used up", None, None)
        assert (rows[1].status, rows[1]["rank"], rows[1].score) == ("ok", 1, 0.0)


def test_figures_and_verdicts_of_a_ruined_run(spark):
    bars = series(spark, A=jump(), FLAT=jump().assign(open=5.0, high=5.0, low=5.0, close=5.0))
    trades = backtest.run_strategy(bars, RUINED)
    curve = backtest.equity_curve(bars, trades)
    keys = ["symbol", "interval"]
    assert {r.symbol for r in curve.select("symbol").distinct().collect()} == {"FLAT"}
    rows = {r.symbol: r for r in stats.with_errors(stats.all_stats(trades, curve, keys, F.lit(8760)), trades, keys).collect()}
    assert (rows["A"].error, rows["A"].trades, rows["A"].total_return_pct) == ("equity used up", None, None)
    assert rows["FLAT"].error is None and rows["FLAT"].trades == 1
    split = stats.split_stats(trades, curve, keys, 0.7, F.lit(8760))
    got = {r.symbol: r for r in verdicts.verdicts(split, keys, None, trades.where("error is not null").select(*keys, "error")).collect()}
    assert (got["A"].grade, got["A"].reasons) == (None, ["The run ended early: equity used up."]) and got["FLAT"].grade == "not_enough_data"
    vote = verdicts.cross_market(spark.createDataFrame([("x", r.symbol, r.grade) for r in got.values()], "run string, symbol string, grade string"), ["run"]).first()
    assert vote.unchecked == ["A"]


def test_folds_are_scored_one_by_one(spark):
    names = ["trades", "wins", "losses", "win_rate_pct", "avg_win_pct", "avg_loss_pct", "profit_factor", "expectancy_pct", "expectancy_stdev_pct", "total_return_pct", "buy_and_hold_pct", "max_drawdown_pct", "sharpe"]
    row = lambda fold, part, pf, e: ("A", "1m", 0, fold, part, 3, 2, 1, 0.0, 0.0, 0.0, pf, e, *[0.0] * 5, None)
    schema = f"symbol string, interval string, trial_id int, fold int, part string, {', '.join(f'{c} ' + ('long' if c in names[:3] else 'double') for c in names)}, error string"
    figures = spark.createDataFrame([row(0, "OOS", None, 1.0), row(1, "OOS", 2.0, 4.0), row(0, "IS", 3.0, 0.0), row(1, "IS", None, 0.0)], schema)
    combos = sweep.grid_combos(spark, [("stop_loss_pct", [1.0])])
    got = sweep.sweep_results(figures, combos, "profit_factor").first()
    assert (got.score, got.is_score) == (1.0, 1.5) and got.oos_profit_factor == 2.0  # a missing factor is a score of 0, and no figure
    assert sweep.sweep_results(figures, combos, "expectancy").first().score == pytest.approx(2.5)


def test_a_sweep_needs_a_valid_strategy():
    good = RUINED | {"stop_loss_pct": 2}
    spec = [{"target": "stop_loss_pct", "kind": "float", "values": [1, 2]}]
    assert sweep.validate_sweep_spec(good, spec) == []
    number = {"left": 1, "op": "<", "right": 2}
    for wrong, error in (
        ({"side": "up"}, "unknown side"), ({"entry": {"all": []}}, "entry has no condition"), ({"entry": {"all": [number]}}, "compares two plain numbers"), ({"stop_loss_pct": 0}, "bad stop_loss_pct"), ({"take_profit_pct": float("nan")}, "bad take_profit_pct"),
        ({"exit": {"any": [{"left": {"ind": "sma"}, "op": ">", "right": 1}]}}, "sma needs a period"), ({"exit": {"any": [{"left": {"ind": "rsi", "period": 0}, "op": ">", "right": 1}]}}, "rsi period must be at least 1"),
        ({"exit": {"any": [{"left": {"ind": "close", "period": 3}, "op": ">", "right": 1}]}}, "close takes no period"), ({"exit": {"any": [{"left": {"ind": "vwap"}, "op": "=", "right": 1}]}}, "unknown operator"),
    ):
        assert error in sweep.validate_sweep_spec(good | wrong, spec), wrong


def test_specs_of_tables_expand_like_single_ones(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["int", "float"]), None, lo := rng.uniform(-5, 5), lo + rng.choice([-1.0, 0.0, 0.4, 3.0, 600.0]), rng.choice([None, 0.0, 0.3, 1.0, 2.6])) for i in range(200)]
    rows += [(200 + i, rng.choice(["int", "float"]), [rng.choice([1.0, 1.4, 2.5, -2.5, 1.0 + 1e-13, float("inf")]) for _ in range(rng.randrange(4))], None, None, None) for i in range(60)]
    rows += [(300, "int", [1.0], 1.0, None, None), (301, "float", None, None, 1.0, 1.0), (302, "float", None, float("nan"), 1.0, 1.0)]
    got = {r.i: (r.expanded, r.error) for r in sweep.expand_specs(spark.createDataFrame(rows, "i int, kind string, values array<double>, min double, max double, step double")).collect()}
    for i, kind, values, low, high, step in rows:
        try:
            want = sweep.expand_values(kind, values, low, high, step)
        except ValueError as e:
            assert got[i] == (None, str(e)), rows[i] if i < len(rows) else i
        else:
            assert got[i][0] == pytest.approx(want, abs=1e-9) and got[i][1] is None, (i, want, got[i])
