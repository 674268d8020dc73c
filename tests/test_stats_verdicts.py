import pytest
from pyspark.sql import functions as F

from barloom.operators import rules, stats, sweep, verdicts


def curve(spark, values, step=3_600_000):
    return spark.createDataFrame([("r", i, i * step, float(v), float(v)) for i, v in enumerate(values)], "run string, idx int, ts long, close double, equity double")


def trades(spark, returns, entries=None):
    return spark.createDataFrame([("r", i, (entries or range(len(returns)))[i], float(r)) for i, r in enumerate(returns)], "run string, trade_no int, entry_idx int, return_pct double")


# Fixed values in what follows: figures and grade boundaries that every right implementation has.
def test_trade_stats(spark):
    r = stats.trade_stats(trades(spark, [4, -2, 6]), ["run"]).first()
    assert (r.trades, r.wins, round(r.win_rate_pct, 2), r.profit_factor, round(r.expectancy_pct, 3)) == (3, 2, 66.67, 5.0, 2.667)
    none = stats.trade_stats(trades(spark, [1]).where("false"), ["run"], curve(spark, [1]).select("run")).first()
    assert (none.trades, none.profit_factor, none.expectancy_pct) == (0, None, 0.0)
    assert stats.trade_stats(trades(spark, [0, 3]), ["run"]).first().losses == 1


def test_drawdowns(spark):
    assert round(stats.max_drawdown(curve(spark, [1, 1.2, 0.9, 1.1]), ["run"]).first().max_drawdown_pct, 9) == 25
    r = stats.drawdown_periods(curve(spark, [1, 1.2, 0.9, 1.1, 1.2]), ["run"]).collect()
    assert [(x.start, x.trough, x.end, round(x.depth_pct, 9), x.length) for x in r] == [(1, 2, 4, 25, 3)]
    assert stats.drawdown_periods(curve(spark, [1, 1.5, 1]), ["run"]).first().end is None


def test_flat_curve_has_no_ratio(spark):
    r = stats.ratio_stats(curve(spark, [1, 1, 1, 1]), ["run"], F.lit(365)).first()
    assert (r.sharpe, r.sortino) == (0.0, 0.0)


def test_split(spark):
    c = curve(spark, [1, 1, 1, 1, 2] + [2.2] * 5)
    got = {r.part: r for r in stats.split_stats(trades(spark, [1, 1, 1, 1], [1, 3, 6, 8]), c, ["run"], 0.5, F.lit(365)).collect()}
    assert (got["IS"].trades, got["OOS"].trades) == (2, 2)
    assert (round(got["IS"].total_return_pct, 9), round(got["OOS"].total_return_pct, 9)) == (100, 10)
    _, _, failed = stats.split_windows(trades(spark, [1]), curve(spark, [1]), ["run"], 0.5)
    assert failed.count() == 1


def test_folds():
    assert stats.folds(40, 3) == [(10, 20, 0), (20, 30, 1), (30, 40, 2)]
    with pytest.raises(ValueError):
        stats.folds(10, 3)


@pytest.mark.parametrize(("t", "e", "pf", "is_e", "want"), [(29, 1.0, 2.0, 1.0, "not_enough_data"), (30, 1.0, 2.0, 1.0, "holds"), (30, 0.0, 2.0, 1.0, "fails"), (30, 1.0, 1.1, 1.0, "fragile"), (30, 1.0, 1.2, 1.0, "holds"), (30, 1.0, None, 1.0, "holds"), (30, 0.5, 2.0, 1.0, "holds"), (30, 0.49, 2.0, 1.0, "fragile"), (30, 0.1, 2.0, -1.0, "holds")])
def test_grades(spark, t, e, pf, is_e, want):
    row = spark.createDataFrame([(t, e, pf, is_e)], "t int, e double, pf double, i double")
    assert row.select(verdicts.grade(*map(F.col, ("t", "e", "pf", "i")))).first()[0] == want


@pytest.mark.parametrize(("grades", "want"), [(["holds"] * 3, "holds"), (["holds", "fails", "holds"], "fails"), (["holds", "fragile"], "fragile"), (["holds", "holds", None], "fragile"), (["holds"], "not_enough_data"), (["not_enough_data"] * 2, "not_enough_data"), (["not_enough_data", "holds"], "fragile")])
def test_cross_market(spark, grades, want):
    df = spark.createDataFrame([("s", i, g) for i, g in enumerate(grades)], "strategy string, symbol int, grade string")
    assert verdicts.cross_market(df, ["strategy"]).first().grade == want


def test_values_and_grid(spark):
    assert sweep.expand_values("int", [2.5, 3, 2]) == [2, 3]
    assert sweep.expand_values("int", low=1, high=6, step=2) == [1, 3, 5, 6]
    assert sweep.expand_values("float", low=1, high=2, step=0.4) == pytest.approx([1, 1.4, 1.8, 2])
    rows = sweep.grid_combos(spark, [("a", [25.0, 30.0]), ("b", [2.0, 3.0, 4.0])]).orderBy("trial_id").collect()
    assert [(r.params["a"], r.params["b"]) for r in rows][:4] == [(25, 2), (25, 3), (25, 4), (30, 2)] and len(rows) == 6
    one = [sweep.random_combos(spark, [("x", (1.0, 2.0)), ("y", [1.0, 2.0])], 50).repartition(n).orderBy("trial_id").collect() for n in (1, 7)]
    assert one[0] == one[1] and all(1 <= r.params["x"] <= 2 for r in one[0])


def test_overfit(spark):
    row = spark.range(1)
    flag = lambda *v: row.select(sweep.overfit_flag(*map(F.lit, v))[0]).first()[0]
    assert flag(1.5, -0.5, 0.0, 0.0) and flag(2.0, 0.5, 0.0, 0.0) and flag(0.2, 0.1, 11.0, -1.0) and not flag(0.2, 0.1, 5.0, 1.0)


def test_sweep_spec():
    s = {"entry": {"all": [{"left": {"ind": "close"}, "op": ">", "right": {"ind": "sma", "period": 10}}]}, "stop_loss_pct": 2}
    good = [{"target": "entry.all.0.right.period", "kind": "int", "min": 5, "max": 9}]
    assert sweep.validate_sweep_spec(s, good) == []
    assert sweep.validate_sweep_spec(s, [{"target": "entry.all.1.right", "kind": "float", "values": [1]}]) == ["entry.all.1.right: no such target"]
    assert sweep.validate_sweep_spec(s, [], split=0.5, k=3)[0] == "1 to 8 parameters are needed"


def test_conditions_tell_numbers_from_objects(spark):
    s = {"x": {"entry": {"all": [{"left": {"ind": "rsi", "period": 14}, "op": "<", "right": 30}]}}}
    r = rules.parse_conditions(rules.strategy_rows(spark, s)).first()
    assert (r.left.num, r.left.ind, r.left.period, r.right.num, r.right.ind) == (None, "rsi", 14, 30.0, None)
