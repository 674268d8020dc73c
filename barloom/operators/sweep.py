"""Parameter sweeps: values, combinations, trials in batches, scores and ranking."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite
from barloom.operators.backtest import TRADE, scan_trades
from barloom.operators.indicators import indicator_values
from barloom.operators.rules import AVERAGES, OPS, PRICES, column_name, operands, rule_flags
from barloom.operators.stats import mean_stats
from barloom.operators.verdicts import side_by_side

MAX_COMBOS, MAX_PARAMS, MAX_VALUES = 2_000, 8, 512


def _round(v: float) -> float:
    return math.copysign(math.floor(abs(v) + 0.5), v)


def expand_values(kind: str, values: list[float] | None = None, low: float | None = None, high: float | None = None, step: float | None = None) -> list[float]:
    """The sorted values of a parameter: listed ones, or a range whose upper end always belongs to it."""
    if values is not None:
        if not values or any(not math.isfinite(v) for v in values) or any(x is not None for x in (low, high, step)):
            raise ValueError("values must be finite, not empty, and without a range")
        out: list[float] = []
        for v in sorted(_round(v) if kind == "int" else float(v) for v in values):
            if not out or v - out[-1] > 1e-12:
                out.append(v)
    else:
        if low is None or high is None or not (math.isfinite(low) and math.isfinite(high)) or low > high:
            raise ValueError("a range needs finite min and max, min first")
        if kind == "int":
            first, last = math.ceil(low), math.floor(high)
            out = [float(v) for v in range(first, last + 1, max(1, int(_round(step or 1))))] if first <= last else []
            last = float(last)
        else:
            if not step or step <= 0:
                raise ValueError("a float range needs a step above 0")
            out, v, last = [], float(low), float(high)
            while v <= high + 1e-9 and len(out) <= MAX_VALUES:
                out.append(min(v, last))
                v += step
        if out and last - out[-1] > 1e-12:
            out.append(last)
    if not out or len(out) > MAX_VALUES:
        raise ValueError("1 to 512 values")
    return out


def expand_specs(specs: DataFrame) -> DataFrame:
    """``specs`` (kind, values, min, max, step) with expanded, the sorted values of each, and error where there are none; ``expand_values`` for tables.

    ``values`` is an array, or NULL where min and max give a range.
    """
    half = lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5)
    is_int, listed = F.col("kind") == "int", F.col("values").isNotNull()
    known = lambda c: F.coalesce(finite(c), F.lit(False))
    step = F.when(is_int, F.greatest(F.lit(1.0), half(F.coalesce("step", F.lit(1.0))))).otherwise(F.col("step"))
    first, last = F.when(is_int, F.ceil("min").cast("double")).otherwise(F.col("min")), F.when(is_int, F.floor("max").cast("double")).otherwise(F.col("max"))
    error = (
        F.when(listed & ((F.size("values") == 0) | F.exists("values", lambda v: ~known(v)) | F.col("min").isNotNull() | F.col("max").isNotNull() | F.col("step").isNotNull()), "values must be finite, not empty, and without a range")
        .when(~listed & (~known(F.col("min")) | ~known(F.col("max")) | (F.col("min") > F.col("max"))), "a range needs finite min and max, min first")
        .when(~listed & ~is_int & (F.coalesce("step", F.lit(0.0)) <= 0), "a float range needs a step above 0")
    )
    rows = specs.withColumn("error", error)
    good = F.col("error").isNull()
    n = F.when(good & ~listed & (step > 0), F.floor((last + F.when(is_int, 0.0).otherwise(1e-9) - first) / F.when(step > 0, step)) + 1)
    steps = F.when(n.between(1, MAX_VALUES), F.transform(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(MAX_VALUES)) - 1), lambda i: F.least(first + i * step, last)))
    ranged = F.when(last - F.element_at(steps, -1) > 1e-12, F.concat(steps, F.array(last))).otherwise(steps)
    none = F.array().cast("array<double>")
    apart = lambda a, v: F.when((F.size(a) == 0) | (v - F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) > 1e-12), F.concat(a, F.array(v))).otherwise(a)
    distinct = F.aggregate(F.array_sort(F.transform("values", lambda v: F.when(is_int, half(v)).otherwise(v))), none, apart)
    out = rows.withColumn("expanded", F.when(good, F.when(listed, distinct).otherwise(ranged)))
    return out.withColumn("error", F.when(good & ~F.coalesce(F.size("expanded").between(1, MAX_VALUES), F.lit(False)), "1 to 512 values").otherwise(F.col("error"))).withColumn("expanded", F.when(F.col("error").isNull(), F.col("expanded")))


def target_exists(strategy: dict, path: str) -> bool:
    return _locate(strategy, path) is not None


def _locate(strategy: dict, path: str) -> tuple[object, object] | None:
    at: object = strategy
    parts = path.split(".")
    for p in parts[:-1]:
        if isinstance(at, list):
            at = at[int(p)] if p.isdigit() and int(p) < len(at) else None
        else:
            at = at.get(p) if isinstance(at, dict) else None
    if isinstance(at, dict) and parts[-1] in ("left", "right", "period", "stop_loss_pct", "take_profit_pct"):
        now = at.get(parts[-1])
        if isinstance(now, (int, float)) or (now is None and len(parts) == 1):
            return at, parts[-1]
    return None


def strategy_errors(strategy: dict) -> list[str]:
    """What is wrong with a strategy that is held on the driver, in the order entry, exit, stop, target; as ``validate_strategies`` tells of tables.

    A side is not asked for, since it is no part of what a sweep changes, but a given one must be known.
    """
    errors = []
    if strategy.get("side", "long") not in ("long", "short"):
        errors.append("unknown side")
    sections = [strategy.get("entry") or {}, strategy.get("exit") or {}]
    if not any(sections[0].get(g) for g in ("all", "any")):
        errors.append("entry has no condition")
    for c in (c for rules in sections for g in ("all", "any") for c in rules.get(g) or []):
        if c.get("op") not in OPS:
            errors.append("unknown operator")
        for o in (c.get("left"), c.get("right")):
            if isinstance(o, dict):
                ind, period = o.get("ind"), o.get("period")
                if ind not in (*PRICES, *AVERAGES):
                    errors.append("unknown indicator")
                elif ind in PRICES and period is not None:
                    errors.append(f"{ind} takes no period")
                elif ind in AVERAGES and (period is None or period < 1):
                    errors.append(f"{ind} needs a period" if period is None else f"{ind} period must be at least 1")
            elif not isinstance(o, (int, float)) or not math.isfinite(o):
                errors.append("unknown indicator")
        if all(isinstance(c.get(s), (int, float)) for s in ("left", "right")):
            errors.append("compares two plain numbers")
    for name in ("stop_loss_pct", "take_profit_pct"):
        v = strategy.get(name)
        if v is not None and not (math.isfinite(v) and v > 0):
            errors.append(f"bad {name}")
    return errors


def validate_sweep_spec(strategy: dict, params: list[dict], method: str = "grid", trials: int | None = None, split: float | None = None, k: int | None = None) -> list[str]:
    """What is wrong with a sweep, in order, its strategy first; empty if it can run."""
    errors = strategy_errors(strategy)
    if not 1 <= len(params) <= MAX_PARAMS:
        errors.append("1 to 8 parameters are needed")
    for p in params:
        if p.get("kind") not in ("int", "float"):
            errors.append(f"{p.get('target')}: kind must be int or float")
            continue
        if str(p["target"]).endswith(".period") and p["kind"] != "int":
            errors.append(f"{p['target']}: a period is an int")
        if not target_exists(strategy, str(p["target"])):
            errors.append(f"{p['target']}: no such target")
        try:
            found = expand_values(p["kind"], p.get("values"), p.get("min"), p.get("max"), p.get("step") or (1 if method == "random" else None))
            if str(p["target"]).endswith(".period") and found[0] < 1:
                errors.append(f"{p['target']}: a period is at least 1")
        except ValueError as e:
            errors.append(f"{p['target']}: {e}")
    if split is not None and k is not None:
        errors.append("either split or folds")
    if trials is not None and (method != "random" or not 1 <= trials <= MAX_COMBOS):
        errors.append("trials need the random method, 1 to 2000")
    return errors


def grid_combos(spark: SparkSession, params: list[tuple[str, list[float]]], cap: int = MAX_COMBOS) -> DataFrame:
    """(trial_id, params): the Cartesian product, the first parameter slowest, by arithmetic on the trial number."""
    total = math.prod(len(v) for _, v in params)
    if total > cap:
        raise ValueError(f"{total} combinations exceed {cap}")
    entries, stride = [], total
    for name, values in params:
        stride //= len(values)
        at = (F.floor(F.col("id") / stride) % len(values)).cast("int")
        entries += [F.lit(name), F.get(F.array(*map(F.lit, values)), at)]
    return spark.range(total).select(F.col("id").cast("int").alias("trial_id"), F.create_map(*entries).alias("params"))


def random_combos(spark: SparkSession, params: list[tuple[str, list[float] | tuple[float, float]]], trials: int = 200, seed: int = 42) -> DataFrame:
    """(trial_id, params): listed values by index, a (min, max) tuple uniformly; the same for any partitioning."""
    entries = []
    for name, values in params:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", F.lit(name)), 11) / float(1 << 53)
        value = F.lit(values[0]) + u * (values[1] - values[0]) if isinstance(values, tuple) else F.get(F.array(*map(F.lit, values)), F.least(F.floor(u * len(values)), F.lit(len(values) - 1)).cast("int"))
        entries += [F.lit(name), value.cast("double")]
    return spark.range(trials).select(F.col("id").cast("int").alias("trial_id"), F.create_map(*entries).alias("params"))


def applied(strategy: dict, params: dict[str, float]) -> dict:
    """The strategy with the values of one trial."""
    out = copy.deepcopy(strategy)
    for path, v in params.items():
        found = _locate(out, path)
        if found is None:
            raise ValueError(f"no such target: {path}")
        at, name = found
        at[name] = int(_round(v)) if name == "period" else float(v)
    return out


def trials_of(combos: DataFrame) -> list[tuple[int, dict[str, float]]]:
    """The trials on the driver: control data of MAX_COMBOS rows at most."""
    rows = combos.select("trial_id", "params").limit(MAX_COMBOS + 1).collect()
    if len(rows) > MAX_COMBOS:
        raise ValueError(f"more than {MAX_COMBOS} combinations")
    return [(r["trial_id"], r["params"]) for r in rows]


def _each_trial(candles: DataFrame, strategy: dict, combos: DataFrame, cost: float, batch: int | None, made: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``made`` makes of bars and trades of each series and trial.

    A series is packed once, as one array for each column, and sent once. Where
    series are fewer than cores, ``batch`` deals the trials to parts of about so
    many, each of which gets the series; a part shares the series' indicators.
    """
    trials, columns = trials_of(combos), ["ts", *PRICES]
    splits = -(-len(trials) // batch) if batch and trials else 1
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    packed = candles.groupBy("symbol", "interval").agg(rows.alias("bars")).select("symbol", "interval", *(F.col(f"bars.{c}").alias(c) for c in columns))
    work = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).repartition("symbol", "interval", "part")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for row in frame.itertuples(index=False):
                bars = pd.DataFrame({c: getattr(row, c) for c in columns})
                known: dict[str, np.ndarray] = {}
                for trial, params in trials[row.part :: splits]:
                    s = applied(strategy, params)
                    for o in operands(s):
                        if (name := column_name(o)) not in known:
                            known[name] = indicator_values(bars, o["ind"], o.get("period"))
                    found = scan_trades(bars, rule_flags(bars, s["entry"], known), rule_flags(bars, s.get("exit"), known), s["side"], stop_pct=s.get("stop_loss_pct"), target_pct=s.get("take_profit_pct"), cost=cost)
                    out = made(bars, found)
                    for name, value in (("trial_id", trial), ("interval", row.interval), ("symbol", row.symbol)):
                        out.insert(0, name, value)
                    yield out

    return work.mapInPandas(run, "symbol string, interval string, trial_id int, " + schema)


def sweep_trades(candles: DataFrame, strategy: dict, combos: DataFrame, fee_bps: float = 5.0, slippage_bps: float = 2.0, batch: int | None = None) -> DataFrame:
    """Trades of every trial on every series."""
    return _each_trial(candles, strategy, combos, (fee_bps + slippage_bps) / 1e4, batch, lambda bars, trades: trades.astype(object), TRADE)


def marked_equity(bars: pd.DataFrame, trades: pd.DataFrame, cost: float) -> np.ndarray:
    """Equity of each bar, as ``equity_curve`` has it, of one sorted series."""
    close, out, equity = bars["close"].to_numpy(), np.ones(len(bars)), 1.0
    for t in trades.itertuples(index=False):
        ratio = close[t.entry_idx : t.exit_idx] / t.entry_price
        out[t.entry_idx : t.exit_idx] = equity * (1 + (1 if t.side == "long" else -1) * (ratio - 1) - cost * (1 + ratio))
        equity *= 1 + t.return_pct / 100
        out[t.exit_idx :] = equity
    return out


def window_figures(returns: np.ndarray, equity: np.ndarray, first_open: float, last_close: float, bars_per_year: float) -> dict[str, float]:
    """The thirteen figures of one window, of its trades' returns and its curve."""
    won, lost = returns[returns > 0], returns[returns <= 0]
    n, gross = len(returns), abs(lost.sum())
    usable = np.isfinite(equity).all() and (equity[:-1] != 0).all()
    growth = equity[1:] / equity[:-1] - 1 if usable and len(equity) > 1 else np.zeros(0)
    spread = growth.std() if len(growth) else 0.0
    peak = np.maximum.accumulate(equity)
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    return {
        "trades": n, "wins": len(won), "losses": len(lost), "win_rate_pct": 100 * len(won) / n if n else 0.0, "avg_win_pct": mean(won), "avg_loss_pct": mean(lost), "profit_factor": float(won.sum() / gross) if gross > 0 else None,
        "expectancy_pct": mean(returns), "expectancy_stdev_pct": float(returns.std()) if n else 0.0,
        "total_return_pct": 100 * (equity[-1] / equity[0] - 1) if equity[0] != 0 else 0.0, "buy_and_hold_pct": 100 * (last_close / first_open - 1) if first_open != 0 else 0.0,
        "max_drawdown_pct": float(np.where(peak > 0, 100 * (peak - equity) / np.where(peak > 0, peak, 1), 0.0).max()), "sharpe": float(growth.mean() / spread * np.sqrt(bars_per_year)) if spread > 1e-15 else 0.0,
    }


STATS = "trades long, wins long, losses long, win_rate_pct double, avg_win_pct double, avg_loss_pct double, profit_factor double, expectancy_pct double, expectancy_stdev_pct double, total_return_pct double, buy_and_hold_pct double, max_drawdown_pct double, sharpe double, error string"


def sweep_stats(candles: DataFrame, strategy: dict, combos: DataFrame, bars_per_year: float, split: float = 0.7, folds: int | None = None, fee_bps: float = 5.0, slippage_bps: float = 2.0, batch: int | None = None) -> DataFrame:
    """(symbol, interval, trial_id, fold, part, figures, error) of every trial: of a split, where fold is 0, or of walk-forward folds.

    A trial that ends in an error has its windows with the error and without figures. The windows are those of ``split_stats`` and ``walk_forward_stats``; only
    their figures leave a task, never the curves. Series too short to be split
    have no rows.
    """
    cost = (fee_bps + slippage_bps) / 1e4

    def made(bars: pd.DataFrame, trades: pd.DataFrame) -> pd.DataFrame:
        n, rows = len(bars), []
        error = trades["error"].dropna().max() if len(trades) else None
        error = error if isinstance(error, str) else None
        trades = trades[trades["trade_no"].notna()]
        entries, returns = trades["entry_idx"].to_numpy(int), trades["return_pct"].to_numpy(float)
        equity, o, c = marked_equity(bars, trades, cost), bars["open"].to_numpy(), bars["close"].to_numpy()
        if folds is None:
            cut = int(np.floor(n * split))
            spans = [(0, "IS", 0, cut), (0, "OOS", cut, n)] if 0 < cut < n and np.isfinite(equity[cut - 1]) and equity[cut - 1] != 0 else []
        else:
            at = [n * i // (folds + 1) for i in range(folds + 2)] if n >= 5 * (folds + 1) else [0]
            spans = [(f, part, a, b) for f in range(len(at) - 2) for part, a, b in (("IS", 0, at[f + 1]), ("OOS", at[f + 1], at[f + 2]))]
        if error is not None:
            rows, spans = [{"fold": fold, "part": part, "error": error} for fold, part, *_ in spans], []
        for fold, part, a, b in spans:
            # the later part of a split starts from 1 at the split's bar, a fold from its own first bar
            curve = equity[a:b] / equity[a] if folds is not None else equity[a:b] if part == "IS" else np.concatenate([[1.0], equity[a:b] / equity[a - 1]])
            rows.append({"fold": fold, "part": part} | window_figures(returns[(entries >= a) & (entries < b)], curve, o[a], c[b - 1], bars_per_year))
        return pd.DataFrame(rows, columns=["fold", "part", *(f.split()[0] for f in STATS.split(", "))], dtype=object)

    return _each_trial(candles, strategy, combos, cost, batch, made, "fold int, part string, " + STATS)


def sweep_results(stats: DataFrame, combos: DataFrame, by: str = "sharpe") -> DataFrame:
    """(symbol, interval, rank, trial_id, params_key, status, error, score, is_score, overfit, overfit_reason, is_*, oos_*) of ``sweep_stats``.

    The objective of the later part is the score, that of the earlier part is
    is_score. Over folds each fold is scored by itself, a missing profit factor
    as 0, and the scores are averaged; figures are means. Trials with status
    ``error`` have no figures and no rank.
    """
    keys = ["symbol", "interval", "trial_id"]
    good = stats.where("error is null").drop("error")
    score = lambda part: F.avg(F.when(F.col("part") == part, objective(by)))
    scores = good.groupBy(*keys).agg(score("OOS").alias("score"), score("IS").alias("is_score"))
    wide = side_by_side(mean_stats(good, keys), keys).join(scores, keys)
    names = combos.select("trial_id", params_key(F.col("params")).alias("params_key"))
    overfit, reason = overfit_flag(F.col("is_sharpe"), F.col("oos_sharpe"), F.col("is_total_return_pct"), F.col("oos_total_return_pct"))
    scored = wide.join(names, "trial_id").withColumns({"overfit": overfit, "overfit_reason": reason, "status": F.lit("ok"), "error": F.lit(None).cast("string")})
    failed = stats.where("error is not null").groupBy(*keys).agg(F.max("error").alias("error")).join(names, "trial_id").withColumn("status", F.lit("error"))
    return rank_trials(scored, ["symbol", "interval"]).unionByName(failed, allowMissingColumns=True)


def objective(name: str, prefix: str = "") -> Column:
    """The score of a run; a missing profit factor is 0."""
    c = {"sharpe": "sharpe", "total_return": "total_return_pct", "expectancy": "expectancy_pct", "profit_factor": "profit_factor"}[name]
    return F.coalesce(F.col(prefix + c), F.lit(0.0))


def rank_trials(scored: DataFrame, keys: list[str], score: str = "score", tie: str = "params_key") -> DataFrame:
    """``scored`` with rank: score from high to low, to nine decimals, then the parameters' text."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), tie)))


def params_key(params: Column) -> Column:
    """A text of the parameters in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def overfit_flag(is_sharpe: Column, oos_sharpe: Column, is_return: Column, oos_return: Column) -> tuple[Column, Column]:
    """(overfit, reason): the first that fits of a Sharpe ratio that turns, one that falls by more than 1, and a return that turns."""
    gap = is_sharpe - oos_sharpe
    reason = (
        F.when((is_sharpe > 0.5) & (oos_sharpe < 0), F.format_string("Sharpe turns: %.2f before the split, %.2f after it", is_sharpe, oos_sharpe))
        .when(gap > 1, F.format_string("Sharpe falls by %.2f: %.2f before the split, %.2f after it", gap, is_sharpe, oos_sharpe))
        .when((is_return > 10) & (oos_return < 0), F.format_string("Return turns: %.1f%% before the split, %.1f%% after it", is_return, oos_return))
    )
    return reason.isNotNull(), reason


def sweep_warnings(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, best_overfit, mostly_overfit): of the first rank, and of the top ten of at least ten trials."""
    top = F.col("rank") <= 10
    return ranked.groupBy(*keys).agg(F.bool_or((F.col("rank") == 1) & F.col("overfit")).alias("best_overfit"), ((F.count("*") >= 10) & (F.count_if(top & F.col("overfit")) > 5)).alias("mostly_overfit"))
