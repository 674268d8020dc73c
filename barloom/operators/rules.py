"""Strategies: parsing, checking, parameters, text, and evaluation on candles."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.clean import SERIES, by_time
from barloom.operators.indicators import crosses, sma, with_recurrences

PRICES = ["open", "high", "low", "close"]
AVERAGES = ["sma", "ema", "rsi"]
OPS = ["<", ">", "crosses_above", "crosses_below"]
MAX_CONDITIONS = 100_000  # conditions of strategies that are evaluated at once
FIELDS = ["asset", "timeframe", "side", "entry", "exit", "stop_loss_pct", "take_profit_pct", "claim"]
OPERAND = "struct<num:double,ind:string,period:int>"
CONDITION = "strategy_id string, section string, grp string, pos int, `left` " + OPERAND + ", op string, `right` " + OPERAND


# -- one strategy, on the driver ----------------------------------------------
def column_name(operand: object) -> str | None:
    """The column of an indicator operand, None for a number."""
    if not isinstance(operand, dict):
        return None
    return operand["ind"] if operand["ind"] in PRICES else f"{operand['ind']}_{operand['period']}"


def operands(strategy: dict) -> list[dict]:
    rules = [strategy["entry"], strategy.get("exit") or {}]
    return [o for r in rules for g in ("all", "any") for c in r.get(g) or [] for o in (c["left"], c["right"]) if isinstance(o, dict)]


def with_indicators(candles: DataFrame, strategies: list[dict]) -> DataFrame:
    """``candles`` with a column for every indicator that the strategies name, each once."""
    found = sorted({(o["ind"], o["period"]) for s in strategies for o in operands(s) if o["ind"] in AVERAGES})
    slow = [x for x in found if x[0] != "sma"]
    out = with_recurrences(candles, slow) if slow else candles
    return out.withColumns({f"sma_{n}": sma(F.col("close"), n) for k, n in found if k == "sma"})


def condition_column(condition: dict, order: Window | None = None) -> Column:
    left, right = ((F.col(column_name(o)) if isinstance(o, dict) else F.lit(float(o))) for o in (condition["left"], condition["right"]))
    op = condition["op"]
    if op in ("<", ">"):
        return F.coalesce(left < right if op == "<" else left > right, F.lit(False))
    return crosses(left, right, op == "crosses_above", order)


def rules_column(rules: dict | None, order: Window | None = None) -> Column:
    """All of 'all' and one of 'any'; false if both are empty."""
    every, some = ([condition_column(c, order) for c in (rules or {}).get(g) or []] for g in ("all", "any"))
    parts = every + ([reduce(lambda a, b: a | b, some)] if some else [])
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def eval_rules(candles: DataFrame, strategy: dict) -> DataFrame:
    """``candles`` with the flags entry and exit_ of one strategy."""
    df = with_indicators(candles, [strategy])
    return df.withColumns({"entry": rules_column(strategy["entry"], by_time()), "exit_": rules_column(strategy.get("exit"), by_time())})


def rule_flags(bars: pd.DataFrame, rules: dict | None, values: dict[str, np.ndarray]) -> np.ndarray:
    """``rules_column`` over one sorted series whose indicators are ``values``, NaN where missing."""

    def operand(o: object) -> np.ndarray:
        return values[column_name(o)] if isinstance(o, dict) else np.full(len(bars), float(o))

    def one(c: dict) -> np.ndarray:
        a, b = operand(c["left"]), operand(c["right"])
        with np.errstate(invalid="ignore"):
            if c["op"] in ("<", ">"):
                return a < b if c["op"] == "<" else a > b
            p, q = np.concatenate([[np.nan], a[:-1]]), np.concatenate([[np.nan], b[:-1]])
            return (p <= q) & (a > b) if c["op"] == "crosses_above" else (p >= q) & (a < b)

    every = [one(c) for c in (rules or {}).get("all") or []]
    some = [one(c) for c in (rules or {}).get("any") or []]
    parts = every + ([np.logical_or.reduce(some)] if some else [])
    return np.logical_and.reduce(parts) if parts else np.zeros(len(bars), bool)


# -- many strategies, as tables -------------------------------------------------
def _unknown_fields(text: str) -> Column:
    """The names that a strategy has no field for, in itself, its claim, rules, conditions and operands; sorted."""
    names = lambda c, known: F.coalesce(F.array_except(F.map_keys(c), F.array(*map(F.lit, known))), F.array().cast("array<string>"))
    part = lambda c: F.from_json(c, "map<string,string>")
    whole = part(F.col(text))
    found = [names(whole, FIELDS), names(part(F.get_json_object(text, "$.claim")), ["win_rate_pct", "quote"])]
    for section in ("entry", "exit"):
        found.append(names(part(F.get_json_object(text, f"$.{section}")), ["all", "any"]))
        for group in ("all", "any"):
            conditions = F.from_json(F.get_json_object(text, f"$.{section}.{group}"), "array<map<string,string>>")
            own = F.transform(conditions, lambda c: F.concat(names(c, ["left", "op", "right"]), *(names(part(c[side]), ["ind", "period"]) for side in ("left", "right"))))
            found.append(F.coalesce(F.flatten(own), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def parse_strategies(texts: DataFrame, key: str = "strategy_id", text: str = "json") -> DataFrame:
    """(key, asset, timeframe, side, stop_loss_pct, take_profit_pct, claimed_win_rate, entry_n, exit_n, error) of strategy JSON.

    error is NULL for a strategy of known fields, side and sections only.
    """
    v = F.try_parse_json(text)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    unknown = _unknown_fields(text)
    count = lambda s: sum((F.coalesce(F.size(get(f"$.{s}.{g}", "array<variant>")), F.lit(0)) for g in ("all", "any")), F.lit(0))
    side = get("$.side", "string")
    error = (
        F.when(v.isNull(), "not JSON")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ",")))
        .when(get("$.asset", "string").isNull() | get("$.timeframe", "string").isNull(), "asset and timeframe are needed")
        .when(~F.coalesce(side.isin("long", "short"), F.lit(False)), "unknown side")
        .when(get("$.entry", "variant").isNull(), "entry is needed")
    )
    return texts.select(
        key,
        *(get(f"$.{c}", "string").alias(c) for c in ("asset", "timeframe", "side")),
        get("$.stop_loss_pct", "double").alias("stop_loss_pct"),
        get("$.take_profit_pct", "double").alias("take_profit_pct"),
        get("$.claim.win_rate_pct", "double").alias("claimed_win_rate"),
        count("entry").alias("entry_n"),
        count("exit").alias("exit_n"),
        error.alias("error"),
    )


def parse_conditions(texts: DataFrame, key: str = "strategy_id", text: str = "json") -> DataFrame:
    """(strategy_id, section, grp, pos, left, op, right): one row for each condition."""
    parts = []
    for section in ("entry", "exit"):
        for grp in ("all", "any"):
            items = F.try_variant_get(F.try_parse_json(text), f"$.{section}.{grp}", "array<variant>")
            parts.append(texts.select(F.col(key).alias("strategy_id"), F.lit(section).alias("section"), F.lit(grp).alias("grp"), F.posexplode(items).alias("pos", "c")))
    rows = reduce(DataFrame.unionByName, parts)

    def operand(side: str) -> Column:
        num = F.when(F.schema_of_variant(F.try_variant_get("c", f"$.{side}", "variant")).startswith("OBJECT"), F.lit(None)).otherwise(F.try_variant_get("c", f"$.{side}", "double"))
        return F.struct(num.alias("num"), F.try_variant_get("c", f"$.{side}.ind", "string").alias("ind"), F.try_variant_get("c", f"$.{side}.period", "int").alias("period"))

    return rows.select("strategy_id", "section", "grp", "pos", operand("left").alias("left"), F.try_variant_get("c", "$.op", "string").alias("op"), operand("right").alias("right"))


def condition_error(max_period: int | None = None) -> Column:
    """The first rule that a condition breaks, NULL if none."""
    error = F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown operator")
    for side in ("left", "right"):
        num, ind, period = (F.col(f"{side}.{f}") for f in ("num", "ind", "period"))
        error = (
            error.when(num.isNull() & ~F.coalesce(ind.isin(*PRICES, *AVERAGES), F.lit(False)), "unknown indicator")
            .when(ind.isin(*AVERAGES) & period.isNull(), F.concat(ind, F.lit(" needs a period")))
            .when(ind.isin(*AVERAGES) & (period < 1), F.concat(ind, F.lit(" period must be at least 1")))
            .when(ind.isin(*PRICES) & period.isNotNull(), F.concat(ind, F.lit(" takes no period")))
        )
        if max_period is not None:
            error = error.when(period > max_period, F.concat(ind, F.lit(" period is too large")))
    return error.when(F.col("left.num").isNotNull() & F.col("right.num").isNotNull(), "compares two plain numbers")


def validate_strategies(strategies: DataFrame, conditions: DataFrame, max_period: int | None = None, max_pct: float | None = None) -> DataFrame:
    """``strategies`` with error: the first in the order entry, exit, stop, target; NULL if valid."""
    order = F.struct(F.col("section") != "entry", F.col("grp") != "all", "pos")
    marked = conditions.withColumn("_e", condition_error(max_period))
    first = marked.groupBy("strategy_id").agg(F.min_by("_e", F.when(F.col("_e").isNotNull(), order)).alias("_bad"))

    def pct(c: str) -> Column:
        bad = F.isnan(c) | (F.col(c) <= 0)
        return bad if max_pct is None else bad | (F.col(c) > max_pct)

    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("entry_n") == 0, "entry has no condition").otherwise(F.col("_bad"))
    error = F.coalesce(error, F.when(pct("stop_loss_pct"), "bad stop_loss_pct").when(pct("take_profit_pct"), "bad take_profit_pct"))
    return strategies.join(first, "strategy_id", "left").withColumn("error", error).drop("_bad")


def eval_conditions(conditions: DataFrame, values: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """(strategy_id, section, symbol, interval, ts, hit): the rules of many strategies on values (symbol, interval, ts, ind, period, value, before).

    The values of a bar are gathered to one map, which meets each strategy once;
    a comparison with a missing value, or a cross without a bar before, is false.
    With ``strategies`` both sections of each have rows, and one without
    conditions is false. Strategies are control data: at most ``MAX_CONDITIONS``
    at once, or ValueError.
    """
    if conditions.limit(MAX_CONDITIONS + 1).count() > MAX_CONDITIONS:
        raise ValueError(f"more than {MAX_CONDITIONS} conditions at once")
    name = lambda ind, period: F.concat_ws(":", ind, period.cast("string"))
    both = F.struct("value", "before")
    bars = values.groupBy(*SERIES, "ts").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("ind"), F.col("period")).alias("k"), both.alias("v")))).alias("v"))
    side = lambda s: F.struct(F.col(f"{s}.num").alias("num"), name(F.col(f"{s}.ind"), F.col(f"{s}.period")).alias("k"))
    sections = conditions.groupBy("strategy_id", "section").agg(F.collect_list(F.struct("grp", side("left").alias("l"), "op", side("right").alias("r"))).alias("cs"))
    if strategies is not None:
        each = strategies.select("strategy_id", F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("section"))
        sections = each.join(sections, ["strategy_id", "section"], "left")

    def found(o: Column) -> Column:
        number = F.struct(o["num"].alias("value"), o["num"].alias("before"))
        return F.when(o["num"].isNotNull(), number).otherwise(F.try_element_at("v", o["k"]))

    def hit(c: Column) -> Column:
        l1, l0, r1, r0 = (c[s][field] for s in ("l", "r") for field in ("value", "before"))
        op = c["op"]
        met = F.when(op == "<", l1 < r1).when(op == ">", l1 > r1).when(op == "crosses_above", (l0 <= r0) & (l1 > r1)).when(op == "crosses_below", (l0 >= r0) & (l1 < r1))
        return F.coalesce(met, F.lit(False))

    looked_up = F.transform("cs", lambda c: F.struct(c["grp"].alias("grp"), c["op"].alias("op"), found(c["l"]).alias("l"), found(c["r"]).alias("r")))
    told = bars.join(F.broadcast(sections)).select("strategy_id", "section", *SERIES, "ts", looked_up.alias("bound"))
    told = told.withColumn("hs", F.transform("bound", lambda c: F.struct(c["grp"].alias("grp"), hit(c).alias("hit"))))
    every = F.forall("hs", lambda h: (h["grp"] != "all") | h["hit"])
    some = F.exists("hs", lambda h: (h["grp"] == "any") & h["hit"]) | ~F.exists("hs", lambda h: h["grp"] == "any")
    return told.select("strategy_id", "section", *SERIES, "ts", F.coalesce(every & some, F.lit(False)).alias("hit"))


def numeric_paths(strategies: DataFrame, conditions: DataFrame) -> DataFrame:
    """(strategy_id, path, value) of every number of a strategy."""
    base = F.concat_ws(".", "section", "grp", F.col("pos").cast("string"))
    parts = []
    for side in ("left", "right"):
        parts.append(conditions.where(F.col(f"{side}.num").isNotNull()).select("strategy_id", F.concat(base, F.lit(f".{side}")).alias("path"), F.col(f"{side}.num").alias("value")))
        parts.append(conditions.where(F.col(f"{side}.period").isNotNull()).select("strategy_id", F.concat(base, F.lit(f".{side}.period")).alias("path"), F.col(f"{side}.period").cast("double").alias("value")))
    for c in ("stop_loss_pct", "take_profit_pct"):
        parts.append(strategies.where(F.col(c).isNotNull()).select("strategy_id", F.lit(c).alias("path"), F.col(c).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def apply_params(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """(trial_id, strategy_id, path, value, error): the numbers of each trial, from overrides (trial_id, path, value).

    Where overrides name a strategy_id too, a trial is of that strategy alone;
    else each trial is of every strategy, which only a few strategies can bear.

    Periods are rounded and 1..100000, stops and targets above 0, all finite;
    an override of a path that the strategy lacks is an error row.
    """
    new = overrides.withColumnRenamed("value", "new")
    if "strategy_id" in overrides.columns:
        every = paths.join(overrides.select("trial_id", "strategy_id").distinct(), "strategy_id")
        joined = every.join(new, ["trial_id", "strategy_id", "path"], "full_outer")
    else:
        every = paths.crossJoin(overrides.select("trial_id").distinct())
        joined = every.join(new, ["trial_id", "path"], "full_outer")
    period = F.col("path").endswith(".period")
    value = F.coalesce(F.when(period, F.signum("new") * F.floor(F.abs("new") + 0.5)).otherwise(F.col("new")), F.col("value"))
    error = (
        F.when(F.col("value").isNull(), "no such target")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "not finite")
        .when(period & ((value < 1) | (value > 100_000)), "period out of range")
        .when(F.col("path").isin("stop_loss_pct", "take_profit_pct") & (value <= 0), "must be above 0")
    )
    return joined.select("trial_id", "strategy_id", "path", value.alias("value"), error.alias("error"))


def number_text(x: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def rules_text(conditions: DataFrame) -> DataFrame:
    """(strategy_id, section, text): e.g. 'RSI(14) < 30 and (CLOSE > 5 or CLOSE < 3)'."""

    def text(side: str) -> Column:
        ind, period = F.upper(F.col(f"{side}.ind")), F.col(f"{side}.period")
        return F.when(F.col(f"{side}.num").isNotNull(), number_text(F.col(f"{side}.num"))).when(period.isNull(), ind).otherwise(F.concat(ind, F.lit("("), period.cast("string"), F.lit(")")))

    one = F.concat_ws(" ", text("left"), F.replace("op", F.lit("_"), F.lit(" ")), text("right"))
    found = conditions.withColumn("t", one).groupBy("strategy_id", "section", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("ts"))
    joined = F.when(F.col("grp") == "all", F.array_join("ts", " and ")).when(F.size("ts") == 1, F.get("ts", F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join("ts", " or "), F.lit(")")))
    parts = found.groupBy("strategy_id", "section").agg(F.max(F.when(F.col("grp") == "all", joined)).alias("a"), F.max(F.when(F.col("grp") == "any", joined)).alias("b"))
    return parts.select("strategy_id", "section", F.concat_ws(" and ", "a", "b").alias("text"))


def summaries(strategies: DataFrame, conditions: DataFrame) -> DataFrame:
    """(strategy_id, summary): one sentence on entry, exit, stop and target."""
    texts = rules_text(conditions).groupBy("strategy_id").agg(*(F.max(F.when(F.col("section") == s, F.col("text"))).alias(s) for s in ("entry", "exit")))
    long = F.col("side") == "long"
    summary = F.concat(
        F.when(long, "Buy ").otherwise("Sell "), F.regexp_replace("asset", "USDT$", ""), F.lit(" when "), F.coalesce("entry", F.lit("")), F.lit("."),
        F.when(F.col("exit").isNotNull(), F.concat(F.when(long, " Sell when ").otherwise(" Buy back when "), F.col("exit"), F.lit("."))).otherwise(""),
        F.when(F.col("stop_loss_pct").isNotNull(), F.concat(F.lit(" Stop "), number_text(F.col("stop_loss_pct")), F.lit("%."))).otherwise(""),
        F.when(F.col("take_profit_pct").isNotNull(), F.concat(F.lit(" Target "), number_text(F.col("take_profit_pct")), F.lit("%."))).otherwise(""),
    )
    return strategies.join(texts, "strategy_id", "left").select("strategy_id", summary.alias("summary"))


def strategy_rows(spark: object, strategies: dict[str, dict]) -> DataFrame:
    """(strategy_id, json) of strategies held on the driver."""
    return spark.createDataFrame([(k, json.dumps(s)) for k, s in strategies.items()], "strategy_id string, json string")
