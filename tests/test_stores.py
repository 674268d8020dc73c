"""The candle store under late rows, and the run store by id."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import batches, sweep
from barloom.operators.backtest import equity_curve, run_strategy
from barloom.sources import runs as store
from barloom.sources.candle_store import merge_candles, stored_candles
from .test_timesplit import series, walk

DAY = 86_400_000
BAR = "symbol string, interval string, ts long, open double, high double, low double, close double, arrival int"


def bar(symbol, ts, price, arrival=0):
    return (symbol, "1h", ts, price, price, price, price, arrival)


def load(spark, path, *rows):
    merge_candles(spark.createDataFrame(list(rows), BAR), path)


def held(spark, path):
    return {(r.symbol, r.ts): (r.close, r.version) for r in stored_candles(spark, path).collect()}


def test_first_to_arrive_stays_and_other_days_are_not_written(spark, tmp_path):
    path = str(tmp_path / "store")
    assert held(spark, path) == {}
    load(spark, path, bar("001", 0, 1.0, 5), bar("001", 0, 2.0, 4), bar("001", DAY, 3.0), bar("B", 0, 4.0))
    load(spark, path)  # nothing
    assert held(spark, path) == {("001", 0): (2.0, 1), ("001", DAY): (3.0, 1), ("B", 0): (4.0, 1)}
    load(spark, path, bar("001", 0, 9.0, -1), bar("001", 60_000, 5.0, 2), bar("001", 60_000, 6.0, 1), bar("C", -1, 7.0))
    assert held(spark, path) == {("001", 0): (2.0, 2), ("001", 60_000): (6.0, 2), ("001", DAY): (3.0, 1), ("B", 0): (4.0, 1), ("C", -1): (7.0, 2)}


def test_a_load_that_is_not_committed_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    load(spark, path, bar("A", 0, 1.0))
    before = held(spark, path)
    half = spark.createDataFrame([bar("A", 0, 8.0), bar("A", 5, 8.0)], BAR).drop("arrival").selectExpr("*", "2L AS version", "0L AS day")
    half.write.mode("append").partitionBy("version", "symbol", "interval", "day").parquet(f"{path}/data")
    assert held(spark, path) == before
    load(spark, path, bar("A", 7, 2.0), bar("A", DAY, 3.0))  # the next load has the version of the one that failed
    assert held(spark, path) == {("A", 0): (1.0, 2), ("A", 7): (2.0, 2), ("A", DAY): (3.0, 2)}
    half.selectExpr("symbol", "interval", "ts", "open", "high", "low", "close", "3L AS version", "9L AS day").write.mode("append").partitionBy("version", "symbol", "interval", "day").parquet(f"{path}/data")
    load(spark, path, bar("B", 0, 4.0))
    assert held(spark, path) == {("A", 0): (1.0, 2), ("A", 7): (2.0, 2), ("A", DAY): (3.0, 2), ("B", 0): (4.0, 3)}


def runs(spark, n=40):
    rows = [(i, "A" if i % 2 else "B", "1h", 0, i, json.dumps({"k": i}), "{bad" if i == 3 else json.dumps({"trades": i, "sharpe": i / 2}), "{}", "[]", "[]") for i in range(n)]
    return spark.createDataFrame(rows, "created_at long, symbol string, interval string, start_ms long, end_ms long, strategy string, stats string, metrics string, equity_curve string, trades string")


def test_runs_by_id(spark, tmp_path):
    path = str(tmp_path / "runs")
    clean = runs(spark)
    store.save_by_id(clean, path)
    saved = store.read_by_id(spark, path)
    listed = store.list_by_id(saved, 5)
    assert "from_json" not in listed._jdf.queryExecution().optimizedPlan().toString()
    want = store.list_runs(store.run_rows(clean), 5)
    assert [(r.created_at, r.sharpe) for r in listed.collect()] == [(r.created_at, r.sharpe) for r in want.collect()]
    one = store.run_rows(clean).where("created_at = 17").first().id
    found = store.get_by_id(saved, one)
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.created_at, r.stats.sharpe) for r in found.collect()] == [(17, 8.5)]


CROSS = {"asset": "A", "timeframe": "1m", "side": "long", "entry": {"all": [{"left": {"ind": "close"}, "op": "crosses_above", "right": {"ind": "sma", "period": 5}}]}, "exit": {"any": [{"left": {"ind": "close"}, "op": "crosses_below", "right": {"ind": "sma", "period": 5}}]}, "stop_loss_pct": 2}


def test_only_the_best_trials_run_again(spark):
    candles = series(spark, A=walk(300, 1), B=walk(200, 2))
    combos = sweep.grid_combos(spark, [("stop_loss_pct", [0.5, 1.0, 2.0]), ("entry.all.0.right.period", [3.0, 6.0])])
    results = sweep.sweep_results(sweep.sweep_stats(candles, CROSS, combos, 8760), combos, "expectancy")
    trades, curves = batches.rerun_best(candles, CROSS, combos, results, 2)
    assert {(r.symbol, r["rank"]) for r in curves.select("symbol", "rank").distinct().collect()} == {(s, k) for s in "AB" for k in (1, 2)}
    params = {r.trial_id: r.params for r in combos.collect()}
    for symbol, rank, trial in {(r.symbol, r["rank"], r.trial_id) for r in curves.select("symbol", "rank", "trial_id").distinct().collect()}:
        own = run_strategy(candles.where(F.col("symbol") == symbol), sweep.applied(CROSS, params[trial]))
        want = [r.equity for r in equity_curve(candles.where(F.col("symbol") == symbol), own).orderBy("idx").collect()]
        assert [r.equity for r in curves.where((F.col("symbol") == symbol) & (F.col("rank") == rank)).orderBy("idx").collect()] == pytest.approx(want)
        assert trades.where((F.col("symbol") == symbol) & (F.col("rank") == rank)).count() == own.count()
