"""Golden simulations, rule goldens, seeded walks and properties of trades and equity."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, rules, sweep
from barloom.operators.backtest import scan_trades
from barloom.operators.indicators import ema_values, indicator_values, rsi_values

M = 60_000


def frame(candles, step=M, start=0):
    return pd.DataFrame([(start + i * step, *map(float, c)) for i, c in enumerate(candles)], columns=["ts", "open", "high", "low", "close"])


def flags(n, *at):
    out = np.zeros(n, bool)
    out[list(at)] = True
    return out


def run(candles, exits=(), **k):
    b = candles if isinstance(candles, pd.DataFrame) else frame(candles)
    t = scan_trades(b, flags(len(b), 0), flags(len(b), *exits), cost=0.0, **k)
    return [(r.entry_idx, r.exit_idx, r.entry_price, pytest.approx(r.exit_price), r.reason) for r in t.itertuples()]


FLAT = (100, 100, 100, 100)
# Prices, brackets and outcomes that every right backtest has.
GOLDENS = [
    ([FLAT, (100, 103, 100, 102), (102,) * 4], {"target_pct": 2}, (1, 1, 100, 102, "TakeProfit")),
    ([FLAT, (100, 101, 97, 100), FLAT], {"stop_pct": 2}, (1, 1, 100, 98, "StopLoss")),
    ([FLAT, (100, 110, 109, 109), (109, 109, 108, 108.5), (108.5,) * 4], {"trail_pct": 1}, (1, 2, 100, 108.9, "Trailing")),
    ([FLAT, (100, 111, 100, 110), (110, 120, 110, 119), (105, 106, 104, 104.5)], {"trail_pct": 10}, (1, 3, 100, 105, "Trailing")),
    ([FLAT, (100, 100.5, 99.5, 100), (105, 106, 104, 105.5), (105.5, 106, 104, 105)], {"exits": (1,)}, (1, 2, 100, 105, "Signal")),
    ([FLAT, (100, 101, 99, 100.5), (100.5, 102, 100, 101.5)], {}, (1, 2, 100, 101.5, "EndOfData")),
    ([FLAT, FLAT, (90, 91, 89, 90)], {"stop_pct": 2, "exits": (1,)}, (1, 2, 100, 90, "Signal")),
    ([FLAT, (100, 101, 99, 100), (90, 95, 85, 92), FLAT], {"stop_pct": 2}, (1, 2, 100, 90, "StopLoss")),
    ([FLAT, (100, 101, 99, 100), (105, 106, 90, 95), FLAT], {"stop_pct": 2, "target_pct": 2}, (1, 2, 100, 105, "TakeProfit")),
    ([FLAT, (100, 101, 99, 100), (100, 110, 90, 100), FLAT], {"stop_pct": 2, "target_pct": 2}, (1, 2, 100, 98, "StopLoss")),
]


@pytest.mark.parametrize(("candles", "rules_", "want"), GOLDENS)
def test_golden(candles, rules_, want):
    assert run(candles, **rules_) == [want]


def test_session_end():
    b = frame([(100, 100.4, 99.8, 100.2), (100.2, 101, 100, 100.8), (100.8, 102, 100.7, 101.5), (101.5, 101.6, 101.4, 101.5)])
    b["ts"] = [570 * M, 571 * M, 572 * M, 600 * M]
    inside = (b["ts"] // M >= 570) & (b["ts"] // M < 600)
    assert run(b, session=inside.to_numpy(), exit_at_session_end=True) == [(1, 2, 100.2, 101.5, "SessionEnd")]


def test_opening_range_fill_cap():
    b = frame([(100, 101, 99, 100), (100, 102, 99.5, 101), (101, 103, 100, 102.5), (102.5, 104, 102, 103.5), (103.5, 107, 103, 106)])
    t = scan_trades(b, np.array([False, False, True, True, True]), np.zeros(5, bool), cost=0.0, stop_pct=2, target_pct=4, rearm=False, fills_per_day=1)
    assert [(r.entry_idx, r.exit_idx, r.entry_price, round(r.exit_price, 6), r.reason) for r in t.itertuples()] == [(3, 4, 102.5, 106.6, "TakeProfit")]


def above(b, level):
    return (b["close"] > level).to_numpy()


def test_rearm_waits_for_a_flat_bar_without_the_signal():
    b = frame([(100, 110, 100, 110), (100, 101, 90, 110), (100, 101, 99, 110), (100, 101, 99, 90), (100, 101, 99, 110), (100, 101, 99, 110), (100, 101, 99, 100)])
    t = scan_trades(b, above(b, 100), np.zeros(7, bool), cost=0.0, stop_pct=2)
    assert [(r.entry_idx, r.exit_idx, r.exit_price, r.reason) for r in t.itertuples()] == [(1, 1, 98, "StopLoss"), (5, 6, 100, "EndOfData")]


def test_flat_price_pays_costs():
    b = frame([FLAT] * 5)
    t = scan_trades(b, above(b, 99), np.zeros(5, bool), cost=0.001)
    assert t["return_pct"].tolist() == [pytest.approx(-0.2)]


def test_used_up_equity_is_an_error():
    b = frame([FLAT, (100, 250, 100, 250), (90, 90, 90, 90), FLAT, FLAT, FLAT, FLAT])
    t = scan_trades(b, np.array([True, False, True, True, False, False, False]), flags(7, 0, 1), "short", cost=0.0, stop_pct=150)
    assert t["error"].tolist() == ["equity used up"]


@pytest.mark.parametrize(("f", "n", "x", "want"), [(ema_values, 3, [1, 2, 3, 4, 5], [None, None, 2, 3, 4]), (ema_values, 2, [10, 11, 12], [None, 10.5, 11.5]), (rsi_values, 2, [10, 11, 12, 13, 14], [None, None, 100, 100, 100]), (rsi_values, 2, [14, 13, 12, 11], [None, None, 0, 0]), (rsi_values, 2, [10, 11, 10, 11], [None, None, 50, 75]), (rsi_values, 9, [1, 2], [None, None]), (ema_values, 0, [1.0], [None])])
def test_recurrences(f, n, x, want):
    got = f(np.array(x, float), n)
    assert [None if np.isnan(v) else pytest.approx(v) for v in got] == want


def test_atr():
    b = pd.DataFrame({"high": [10.0, 11, 12], "low": [9.0, 9.5, 10], "close": [9.5, 10.5, 11]})
    assert np.round(indicator_values(b, "atr", 2)[1:], 9).tolist() == [1.25, 1.625]


def walk(n, seed=42, step=3_600_000, start=1_700_006_400_000):
    state, prev, rows = seed, 100.0, []

    def draw():
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        return (state >> 33) / 2**31

    for i in range(n):
        close = prev * (1 + (draw() - 0.5) * 0.02)
        rows.append((start + i * step, prev, max(prev, close) + draw() * 0.5, min(prev, close) - draw() * 0.5, close))
        prev = close
    return pd.DataFrame(rows, columns=["ts", "open", "high", "low", "close"])


def cond(left, op, right):
    o = lambda x: x if isinstance(x, (int, float)) else {"ind": x} if isinstance(x, str) else {"ind": x[0], "period": x[1]}
    return {"left": o(left), "op": op, "right": o(right)}


CROSS = {"side": "long", "entry": {"all": [cond("close", "crosses_above", ("sma", 10))]}, "exit": {"all": [cond("close", "crosses_below", ("sma", 10))]}, "stop_loss_pct": 2, "take_profit_pct": 4}
WALKS = [
    ({"side": "long", "entry": {"all": [cond("close", ">", 100)]}}, 1),
    (CROSS, 383),
    ({"side": "long", "entry": {"all": [cond(("rsi", 14), "<", 30)]}, "exit": {"any": [cond(("rsi", 14), ">", 55)]}, "stop_loss_pct": 2, "take_profit_pct": 4}, 40),
    ({"side": "short", "entry": {"all": [cond("close", "crosses_below", ("ema", 20))]}, "exit": {"all": [cond("close", "crosses_above", ("ema", 20))]}, "stop_loss_pct": 1, "take_profit_pct": 2}, 320),
    ({"side": "long", "entry": {"all": [cond("close", ">", ("sma", 20)), cond(("rsi", 14), "<", 70)], "any": [cond("close", "crosses_above", ("ema", 10))]}, "exit": {"all": [cond("close", "<", ("sma", 20))]}, "stop_loss_pct": 2}, 199),
]


def series(spark, bars, *symbols):
    df = spark.createDataFrame(bars)
    return df.select(F.explode(F.array(*map(F.lit, symbols))).alias("symbol"), F.lit("1h").alias("interval"), "*")


@pytest.mark.parametrize(("strategy", "trades"), WALKS)
def test_seeded_walk_counts(spark, strategy, trades):
    assert backtest.run_strategy(series(spark, walk(5000), "X"), strategy, 0, 0).count() == trades


def test_default_costs_walk(spark):
    t = backtest.run_strategy(series(spark, walk(3000), "X"), CROSS).orderBy("trade_no").collect()
    assert len(t) == 226 and [(r.entry_idx, r.exit_idx) for r in t[:3]] == [(11, 19), (22, 25), (30, 43)]


def test_sweep_equals_single_runs(spark):
    params = [("stop_loss_pct", [1.0, 2.0, 3.0]), ("take_profit_pct", [2.0, 4.0])]
    t = sweep.sweep_trades(series(spark, walk(2000), "X", "Y"), CROSS, sweep.grid_combos(spark, params), batch=4)
    got = {(r.symbol, r.trial_id): r["count"] for r in t.groupBy("symbol", "trial_id").count().collect()}
    assert [got["X", i] for i in range(6)] == [163, 160, 152, 148, 152, 148] == [got["Y", i] for i in range(6)]


def test_truncation_gives_a_prefix(spark):
    b = walk(1200)
    whole = backtest.run_strategy(series(spark, b, "X"), CROSS).where("reason <> 'EndOfData'").toPandas()
    part = backtest.run_strategy(series(spark, b[:700], "X"), CROSS).where("reason <> 'EndOfData'").toPandas()
    pd.testing.assert_frame_equal(whole[whole["exit_idx"] < 699].reset_index(drop=True), part.reset_index(drop=True))


def test_equity_is_the_compounded_returns(spark):
    b = series(spark, walk(800), "X", "Y")
    t = backtest.run_strategy(b, CROSS)
    curve = backtest.equity_curve(b, t)
    last = {r.symbol: r.e for r in curve.groupBy("symbol").agg(F.max_by("equity", "idx").alias("e")).collect()}
    want = {r.symbol: r.e for r in t.groupBy("symbol").agg(F.product(1 + F.col("return_pct") / 100).alias("e")).collect()}
    assert last == pytest.approx(want)
    assert curve.where("idx = 0").select("equity").first()[0] == 1.0


def test_rules_of_many_strategies_equal_single_ones(spark):
    b = series(spark, walk(300), "X")
    s = {"side": "long", "asset": "X", "timeframe": "1h", "entry": {"all": [cond("close", "crosses_above", "open"), cond("close", ">", 99)], "any": [cond("high", "<", 104)]}}
    w = rules.by_time()
    cols = ["open", "high", "close"]
    v = b.withColumns({f"{c}_b": F.lag(c).over(w) for c in cols})
    v = v.select("symbol", "interval", "ts", F.explode(F.array(*(F.struct(F.lit(c).alias("ind"), F.lit(None).cast("int").alias("period"), F.col(c).alias("value"), F.col(f"{c}_b").alias("before")) for c in cols))).alias("x")).select("symbol", "interval", "ts", "x.*")
    many = rules.eval_conditions(rules.parse_conditions(rules.strategy_rows(spark, {"a": s})), v).where("hit").select("ts")
    one = rules.eval_rules(b, s).where("entry").select("ts")
    assert sorted(many.collect()) == sorted(one.collect()) and one.count() > 0
