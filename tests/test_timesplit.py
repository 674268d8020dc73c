"""Series split by time against the same work on whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, indicators, rules, timesplit
from barloom.operators.backtest import TRADE_NAMES

M = 60_000
SPANS = [7, 50, 100_000]


def walk(n, seed=1, gaps=False):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    o = np.concatenate([[100], close[:-1]]) * (1 + rng.normal(0, 0.004, n))
    ts = np.arange(n) * M
    if gaps:
        ts = ts + np.cumsum(rng.integers(0, 4, n) * 5) * M  # missing bars, empty buckets
    return pd.DataFrame({"ts": ts, "open": o, "high": np.maximum(o, close) * (1 + abs(rng.normal(0, 0.003, n))), "low": np.minimum(o, close) * (1 - abs(rng.normal(0, 0.003, n))), "close": close})


def series(spark, **frames):
    both = pd.concat([f.assign(symbol=name, interval="1m") for name, f in frames.items()])
    return spark.createDataFrame(both).repartition(5)


@pytest.fixture(scope="module")
def candles(spark):
    return series(spark, LONG=walk(400, 1, True), SHORT=walk(9, 2), ONE=walk(1, 3))


@pytest.mark.parametrize("bars", SPANS)
def test_numbers_and_neighbours(spark, candles, bars):
    rows = timesplit.numbered(candles, span=F.lit(bars * M))
    rows = timesplit.with_next(timesplit.with_previous(rows, {"close": "before", "ts": "ts_before"}), {"open": "after"})
    rows = timesplit.with_next_known(rows, F.when(F.col("idx") % 11 == 5, F.col("idx")), "known").toPandas()
    for _, g in rows.groupby("symbol"):
        g = g.sort_values("ts").reset_index()
        n = len(g)
        assert list(g["idx"]) == list(range(n)) and set(g["n"]) == {n}
        assert g["before"][1:].tolist() == g["close"][:-1].tolist() and np.isnan(g["before"][0]) and g["after"][:-1].tolist() == g["open"][1:].tolist() and np.isnan(g["after"][n - 1])
        want = [next((j for j in range(i, n) if j % 11 == 5), None) for i in range(n)]
        assert [None if np.isnan(x) else int(x) for x in g["known"].astype(float)] == want


@pytest.mark.parametrize("bars", SPANS)
def test_recurrences(spark, candles, bars):
    wanted = [("ema", 12), ("ema", 90), ("rsi", 14), ("atr", 9), ("ema", 1), ("rsi", 1), ("ema", 0)]
    names = [f"{k}_{n}" for k, n in wanted]
    got = timesplit.split_recurrences(candles, wanted, F.lit(bars * M)).toPandas().sort_values(["symbol", "ts"])
    want = indicators.with_recurrences(candles, wanted).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want) == 410
    for c in names:
        assert (got[c].isna().to_numpy() == want[c].isna().to_numpy()).all(), c
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("size", [1, 6, 1000])
def test_windows_and_rules(spark, candles, size):
    """A window may reach back over many blocks; flags equal those of whole series."""
    strategy = {"entry": {"all": [{"left": {"ind": "close"}, "op": "crosses_above", "right": {"ind": "sma", "period": 15}}]}, "exit": {"any": [{"left": {"ind": "rsi", "period": 5}, "op": ">", "right": 60}, {"left": {"ind": "sma", "period": 3}, "op": "crosses_below", "right": {"ind": "sma", "period": 0}}]}}
    names = ["symbol", "ts", "sma_15", "sma_3", "entry", "exit_"]
    got = timesplit.split_rules(candles, strategy, F.lit(20 * M), size).select(names).toPandas().sort_values(["symbol", "ts"])
    want = rules.eval_rules(candles, strategy).select(names).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want) == 410 and want["entry"].sum() > 5 and want["exit_"].sum() > 5
    for c in names[1:]:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-12, equal_nan=True), c


def flagged(spark, rng, **frames):
    return series(spark, **{k: f.assign(entry=rng.random(len(f)) < p, exit_=rng.random(len(f)) < 0.02, side=rng.choice(["long", "short"], len(f))) for k, (f, p) in frames.items()})


def same(got, want):
    key = ["symbol", "trade_no"]
    got, want = (x.toPandas()[["symbol", *TRADE_NAMES]].sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in ("symbol", "side", "reason", "error"):
        assert got[c].fillna("").tolist() == want[c].fillna("").tolist(), c
    for c in ("trade_no", "entry_idx", "exit_idx", "entry_ts", "exit_ts", "entry_price", "exit_price", "return_pct"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12, equal_nan=True), c
    return want


@pytest.mark.parametrize("bars,stop,target,rearm", [(7, 2.0, 3.0, True), (50, 2.0, 3.0, True), (100_000, 2.0, 3.0, True), (7, 9.0, None, False), (50, None, 12.0, True), (7, None, None, False)])
def test_trades(spark, bars, stop, target, rearm):
    rng = np.random.default_rng(5)
    df = flagged(spark, rng, A=(walk(500, 1, True), 0.1), B=(walk(300, 2), 0.9), C=(walk(60, 3), 0.0), D=(walk(2, 4), 1.0), E=(walk(40, 6), 1.0))
    got = timesplit.split_trades(df, stop_pct=stop, target_pct=target, rearm=rearm, span=F.lit(bars * M))
    want = backtest.backtest_trades(df, stop_pct=stop, target_pct=target, rearm=rearm)
    assert len(same(got, want)) > 4


def test_runs_that_end_in_an_error(spark):
    up = walk(80, 1)
    up.loc[40:, ["open", "high", "low", "close"]] *= 5  # shorts lose more than all
    bad = walk(80, 2)
    bad.loc[30:, ["open", "low", "close"]] = -1.0
    rng = np.random.default_rng(1)
    df = flagged(spark, rng, UP=(up, 0.5), BAD=(bad, 0.5), FINE=(walk(80, 3), 0.5)).withColumn("side", F.lit("short"))
    got = timesplit.split_trades(df, stop_pct=50.0, span=F.lit(9 * M))
    want = same(got, backtest.backtest_trades(df, stop_pct=50.0))
    assert set(want["error"].dropna()) == {"equity used up", "bad entry price"}


def test_no_bars_and_no_signals(spark):
    df = flagged(spark, np.random.default_rng(1), A=(walk(20), 0.0))
    assert timesplit.split_trades(df, stop_pct=1.0, span=F.lit(5 * M)).count() == 0
    assert timesplit.split_trades(df.limit(0), stop_pct=1.0, span=F.lit(5 * M)).count() == 0


def plain_fill(bars, start, side, kind, price):
    for i in range(start, len(bars)):
        o, h, lo = bars.loc[i, ["open", "high", "low"]]
        if kind == "market":
            return i, o
        if (side == "buy") == (kind == "limit"):
            if o <= price or lo <= price:
                return i, min(o, price)
        elif o >= price or h >= price:
            return i, max(o, price)
    return None, None


@pytest.mark.parametrize("bars", SPANS)
def test_resting_orders(spark, bars):
    rng = np.random.default_rng(3)
    f = walk(300, 8)
    rows = timesplit.numbered(series(spark, A=f, B=walk(50, 9)), span=F.lit(bars * M))
    made = [("A", "1m", int(rng.integers(0, 310)), str(rng.choice(["buy", "sell"])), str(rng.choice(["limit", "stop", "market"])), float(100 * np.exp(rng.normal(0, 0.1)))) for _ in range(200)]
    made += made[:3] + [("NONE", "1m", 0, "buy", "limit", 1.0)]
    got = timesplit.resting_fills(spark.createDataFrame(made, "symbol string, interval string, from_idx int, side string, kind string, price double"), rows).collect()
    assert len(got) == len(made)
    for r in got:
        want = plain_fill(f, r.from_idx, r.side, r.kind, r.price) if r.symbol == "A" else (None, None)
        assert (r.fill_idx, r.fill_price) == want, r
