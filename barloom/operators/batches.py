"""Backtests of strategies that are rows of a table, on the series that each of them asks for.

A run is (strategy_id, symbol, interval). A strategy becomes one row: its side,
brackets and conditions. The runs of a series are dealt to batches; a batch gets
the packed series once, computes each indicator that its strategies name once,
and gives the trades of all its runs. What was asked for and has no trades stays
visible in ``run_report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.backtest import TRADE, equity_curve, scan_trades
from barloom.operators.clean import SERIES
from barloom.operators.indicators import indicator_values
from barloom.operators.rules import PRICES, column_name, operands, parse_conditions, parse_strategies, rule_flags, strategy_rows, validate_strategies
from barloom.operators.sweep import applied, trials_of
from barloom.operators.verdicts import compare_claim
from barloom.sources.paths import materialise

#: Runs that share one copy of a series, about.
BATCH = 64
RUN = ["strategy_id", *SERIES]


def programs(strategies: DataFrame, conditions: DataFrame) -> DataFrame:
    """(strategy_id, side, stop_loss_pct, take_profit_pct, rules): a row for each strategy without error, with all its conditions.

    ``strategies`` and ``conditions`` are those of ``parse_strategies``, checked
    by ``validate_strategies``, and ``parse_conditions``.
    """
    rules = conditions.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("section", "grp", "pos", "left", "op", "right"))).alias("rules"))
    return strategies.where("error is null").select("strategy_id", "side", "stop_loss_pct", "take_profit_pct").join(rules, "strategy_id")


def own_runs(strategies: DataFrame) -> DataFrame:
    """The runs that strategies ask for themselves: their asset in their timeframe."""
    return strategies.where("error is null").select("strategy_id", F.col("asset").alias("symbol"), F.col("timeframe").alias("interval"))


def runs_on(strategies: DataFrame, markets: DataFrame) -> DataFrame:
    """The runs of every strategy without error on each of its ``markets`` (strategy_id, symbol, interval)."""
    return markets.select(*RUN).distinct().join(strategies.where("error is null").select("strategy_id"), "strategy_id", "left_semi")


def as_rules(rules: list) -> dict[str, dict]:
    """The sections of a program's conditions as ``rules`` has them: {section: {all: [...], any: [...]}}."""
    operand = lambda o: o["num"] if o["num"] is not None else {"ind": o["ind"]} | ({"period": int(o["period"])} if o["period"] is not None else {})
    out: dict[str, dict] = {"entry": {}, "exit": {}}
    for r in rules:
        out[r["section"]].setdefault(r["grp"], []).append({"left": operand(r["left"]), "op": r["op"], "right": operand(r["right"])})
    return out


def backtest_runs(candles: DataFrame, programs: DataFrame, runs: DataFrame, fee_bps: float = 5.0, slippage_bps: float = 2.0, batch: int = BATCH) -> DataFrame:
    """(strategy_id, symbol, interval, trade...) of each of ``runs`` whose strategy and series exist, as ``run_strategy`` makes them one by one.

    Repeated runs count once. A run without trades has no row, one that fails a row with error.
    """
    cost = (fee_bps + slippage_bps) / 1e4
    asked = runs.select(*RUN).distinct().join(programs, "strategy_id")
    sizes = asked.groupBy(*SERIES).agg(F.ceil(F.count("*") / batch).alias("parts"))
    one = F.struct("strategy_id", "side", "stop_loss_pct", "take_profit_pct", "rules")
    dealt = asked.join(sizes, SERIES).withColumn("part", F.pmod(F.xxhash64("strategy_id"), "parts"))
    batches = dealt.groupBy(*SERIES, "part").agg(F.collect_list(one).alias("programs"))
    columns = ["ts", *PRICES]
    packed = candles.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("bars")).select(*SERIES, *(F.col(f"bars.{c}").alias(c) for c in columns))
    work = batches.join(packed, SERIES).repartition(*SERIES, "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                bars = pd.DataFrame({c: getattr(row, c) for c in columns})
                known = {}
                for p in row.programs:
                    rules = as_rules(p["rules"])
                    for o in operands(rules):
                        if (name := column_name(o)) not in known:
                            known[name] = indicator_values(bars, o["ind"], o.get("period"))
                    number = lambda v: None if v is None or v != v else float(v)
                    found = scan_trades(bars, rule_flags(bars, rules["entry"], known), rule_flags(bars, rules["exit"], known), p["side"], stop_pct=number(p["stop_loss_pct"]), target_pct=number(p["take_profit_pct"]), cost=cost)
                    found = found.astype(object)
                    for name, value in zip(reversed(RUN), (row.interval, row.symbol, p["strategy_id"]), strict=True):
                        found.insert(0, name, value)
                    yield found

    return work.mapInPandas(run, f"strategy_id string, symbol string, interval string, {TRADE}")


def run_report(runs: DataFrame, strategies: DataFrame, candles: DataFrame, trades: DataFrame) -> DataFrame:
    """(strategy_id, symbol, interval, status, reason, bars, trades, wins, expectancy_pct, return_pct) of every requested run.

    status is ``rejected`` where the strategy is unknown or has an error,
    ``unchecked`` where the market has no candles, ``error`` where the run failed,
    and else ``ok``; only then there are figures, also of runs without trades.
    """
    series = candles.groupBy(*SERIES).agg(F.count("*").alias("bars"))
    good = F.col("trade_no").isNotNull()
    growth = F.product(F.when(good, 1 + F.col("return_pct") / 100))
    figures = trades.groupBy(*RUN).agg(F.max("error").alias("failed"), F.count_if(good).alias("made"), F.count_if(F.col("return_pct") > 0).alias("won"), F.avg("return_pct").alias("mean"), (100 * (F.coalesce(growth, F.lit(1.0)) - 1)).alias("grown"))
    known = strategies.select("strategy_id", F.lit(True).alias("known"), F.col("error").alias("wrong"))
    rows = runs.select(*RUN).distinct().join(known, "strategy_id", "left").join(series, SERIES, "left").join(figures, RUN, "left")
    reason = (
        F.when(F.col("known").isNull(), F.lit("no such strategy"))
        .when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when(F.col("bars").isNull(), F.concat(F.lit("no candles of "), F.col("symbol"), F.lit(" in "), F.col("interval")))
        .when(F.col("failed").isNotNull(), F.col("failed"))
    )
    status = F.when(F.col("known").isNull() | F.col("wrong").isNotNull(), "rejected").when(F.col("bars").isNull(), "unchecked").when(F.col("failed").isNotNull(), "error").otherwise("ok")
    figure = lambda c, none: F.when(F.col("status") == "ok", F.coalesce(c, F.lit(none)))
    told = rows.withColumns({"status": status, "reason": reason})
    return told.select(*RUN, "status", "reason", "bars", figure("made", 0).cast("long").alias("trades"), figure("won", 0).cast("long").alias("wins"), figure("mean", 0.0).alias("expectancy_pct"), figure("grown", 0.0).alias("return_pct"))


def best_runs(report: DataFrame, k: int = 1, by: str = "return_pct") -> DataFrame:
    """The ``k`` runs of each series with the highest figure ``by``, to nine decimals, the smaller strategy_id first; runs that didn't go well take no part."""
    order = Window.partitionBy(*SERIES).orderBy(F.desc(F.round(by, 9)), "strategy_id")
    return report.where("status = 'ok'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_saved(report: DataFrame, texts: DataFrame, candles: DataFrame, created_at: int) -> DataFrame:
    """The runs of ``report`` that went well as rows of the run store: with their strategy's text, range of bars and figures."""
    span = candles.groupBy(*SERIES).agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"))
    rows = report.where("status = 'ok'").join(span, SERIES).join(texts.select("strategy_id", F.col("json").alias("strategy")), "strategy_id")
    rate = 100 * F.col("wins") / F.when(F.col("trades") > 0, F.col("trades"))
    none = F.array().cast("array<double>")
    figures = F.struct("trades", F.coalesce(rate, F.lit(0.0)).alias("win_rate_pct"), F.col("return_pct").alias("total_return_pct"))
    return rows.select(F.lit(created_at).cast("long").alias("created_at"), *SERIES, "start_ms", "end_ms", "strategy", figures.alias("stats"), F.struct("expectancy_pct").alias("metrics"), none.alias("equity_curve"), none.alias("trades"))


def rerun_best(candles: DataFrame, strategy: dict, combos: DataFrame, results: DataFrame, k: int = 3, fee_bps: float = 5.0, slippage_bps: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(trades, curves) of the ``k`` best trials of each series of a sweep, with rank and trial_id.

    A sweep gives figures only; its best trials alone are run again for what is
    as long as the series. ``results`` are those of ``sweep_results``.
    """
    spark = candles.sparkSession
    best = results.where(F.col("rank") <= k).select(*SERIES, "rank", "trial_id", F.col("trial_id").cast("string").alias("strategy_id"))
    wanted = {r["trial_id"] for r in best.select("trial_id").distinct().collect()}  # control data, as all trials are
    texts = strategy_rows(spark, {str(i): applied(strategy, params) for i, params in trials_of(combos) if i in wanted})
    conditions = parse_conditions(texts)
    made = backtest_runs(candles, programs(validate_strategies(parse_strategies(texts), conditions), conditions), best, fee_bps, slippage_bps)
    made = materialise(made, "best")
    curves = equity_curve(candles.join(best.select(*RUN), SERIES), made, RUN, cost=(fee_bps + slippage_bps) / 1e4)
    named = best.select(*RUN, "rank", "trial_id")
    return made.join(named, RUN).drop("strategy_id"), curves.join(named, RUN).drop("strategy_id")


def with_claims(report: DataFrame, strategies: DataFrame) -> DataFrame:
    """``report`` with claimed_win_rate and held: whether the run won as often as its strategy claims; NULL without claim or trades."""
    claims = strategies.select("strategy_id", "claimed_win_rate")
    rate = 100 * F.col("wins") / F.when(F.col("trades") > 0, F.col("trades"))
    return report.join(claims, "strategy_id", "left").withColumn("held", compare_claim(F.col("claimed_win_rate"), rate)[0])
