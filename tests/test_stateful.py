"""A user's strategy with a state against a plain loop over bars."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, rules, verdicts
from barloom.operators.backtest import Strategy, scan_stateful, scan_trades
from .test_timesplit import series, walk

HOUR, DAY = 60, 60 * 24  # of the made series: bars are minutes, and a day has 1,440 of them
MS = 86_400_000


class Halved(Strategy):
    """Takes every second signal of a day after two fills on it."""

    def __init__(self, entry, exit_):
        self.entry, self.exit_, self.fills = entry, exit_, {}

    def signals(self, bars, start):
        day = (bars["ts"] // MS).to_numpy()
        busy = np.array([self.fills.get(d, 0) >= 2 for d in day])
        return self.entry & ~(busy & (np.arange(len(day)) % 2 == 1)), self.exit_, "long"

    def filled(self, bars, at, side):
        assert side == "long"
        day = int(bars["ts"].iloc[at]) // MS
        self.fills[day] = self.fills.get(day, 0) + 1


def plain(bars, entry, exit_, rearm):
    """(entry bar, exit bar) of trades without stops."""
    o, out, fills, n = bars["open"], [], {}, len(bars)
    position = pending = None
    leave, armed = False, True
    for i in range(n):
        day = bars["ts"][i] // MS
        closed = False
        if position is not None and leave:
            out.append((position, i))
            position, leave, closed = None, False, True
            armed = not rearm
        if pending is not None and position is None and not closed:
            position, pending = i, None
            fills[day] = fills.get(day, 0) + 1
        if i == n - 1:
            if position is not None:
                out.append((position, i))
            break
        if position is not None:
            leave = bool(exit_[i])
        else:
            signal = bool(entry[i]) and not (fills.get(day, 0) >= 2 and i % 2 == 1)
            if signal and armed:
                pending = i
            elif not signal:
                armed = True
    assert len(o) == n
    return out


@pytest.mark.parametrize("rearm", [True, False])
def test_state_changes_what_is_traded(rearm):
    rng = np.random.default_rng(4)
    bars = walk(3000, 3)
    entry, exit_ = rng.random(3000) < 0.3, rng.random(3000) < 0.2
    got = scan_stateful(bars, Halved(entry, exit_), rearm=rearm, cost=0.0)
    assert list(zip(got["entry_idx"], got["exit_idx"], strict=True)) == plain(bars, entry, exit_, rearm)
    assert list(got["trade_no"]) == list(range(len(got))) and len(got) < len(scan_trades(bars, entry, exit_, rearm=rearm, cost=0.0))


def test_on_series(spark):
    class Never(Strategy):
        def signals(self, bars, start):
            return np.zeros(len(bars), bool), np.zeros(len(bars), bool), "long"

    class Always(Strategy):
        def signals(self, bars, start):
            return np.ones(len(bars), bool), np.ones(len(bars), bool), "short"

    candles = series(spark, A=walk(50, 1), B=walk(20, 2))
    assert backtest.stateful_trades(candles, Never).count() == 0
    got = backtest.stateful_trades(candles, Always, rearm=False).groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_no").alias("last")).collect()
    assert {(r.symbol, r.n, r.last) for r in got} == {("A", r.n, r.n - 1) if r.symbol == "A" else ("B", r.n, r.n - 1) for r in got} and len(got) == 2


def test_trials_that_name_a_strategy(spark):
    paths = spark.createDataFrame([("a", "x.period", 3.0), ("a", "stop_loss_pct", 1.0), ("b", "x.period", 5.0)], "strategy_id string, path string, value double")
    wanted = spark.createDataFrame([(0, "a", "x.period", 7.4), (1, "b", "x.period", 9.0), (2, "b", "stop_loss_pct", 1.0)], "trial_id int, strategy_id string, path string, value double")
    got = {(r.trial_id, r.strategy_id, r.path): (r.value, r.error) for r in rules.apply_params(paths, wanted).collect()}
    assert got == {(0, "a", "x.period"): (7.0, None), (0, "a", "stop_loss_pct"): (1.0, None), (1, "b", "x.period"): (9.0, None), (2, "b", "x.period"): (5.0, None), (2, "b", "stop_loss_pct"): (1.0, "no such target")}
    assert "Cartesian" not in rules.apply_params(paths, wanted)._jdf.queryExecution().executedPlan().toString()


def test_requested_markets_without_candles_are_unchecked(spark):
    asked = spark.createDataFrame([("X", "1h"), ("Y", "1h"), ("Z", "1h")], "symbol string, interval string")
    graded = spark.createDataFrame([("X", "1h", "holds"), ("Y", "1h", None)], "symbol string, interval string, grade string")
    rows = verdicts.requested(asked, graded, ["symbol", "interval"])
    assert {r.symbol: r.unchecked_reason for r in rows.collect()} == {"X": None, "Y": "the run failed", "Z": "no candles of Z in 1h"}
    assert verdicts.cross_market(rows, ["interval"]).first().unchecked == ["Y", "Z"]


def test_a_section_without_conditions_is_false(spark):
    texts = rules.strategy_rows(spark, {"a": {"asset": "X", "timeframe": "1h", "side": "long", "entry": {"all": [{"left": {"ind": "close"}, "op": ">", "right": 1}]}}})
    values = spark.createDataFrame([("X", "1h", 0, "close", None, 2.0, None)], "symbol string, interval string, ts long, ind string, period int, value double, before double")
    strategies = rules.parse_strategies(texts)
    got = {r.section: r.hit for r in rules.eval_conditions(rules.parse_conditions(texts), values, strategies).collect()}
    assert got == {"entry": True, "exit": False}
