"""Verdicts over in-sample and out-of-sample figures, over markets and over timeframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grading rules.
MIN_TRADES, MIN_NOISE, SMALL_SAMPLE, PROFIT_FACTOR, RETENTION, MIN_MARKETS = 30, 10, 100, 1.2, 0.5, 2
TIMEFRAMES = ["15m", "1h", "4h", "1d"]
# The two sentences on noise, as formats.
OUTSIDE_NOISE = "The average of %.2f%% per trade is well outside normal noise."
WITHIN_NOISE = "With %d trades, the average of %.2f%% per trade is within normal noise (about plus or minus %.2f%%)."
#: The other sentences, as formats, which the SQL of the queries uses too.
SUMMARY = "After the split: %d trades making %.2f%% each, gains over losses %s."
NONE_LOST = "undefined, as none lost"
LAG = "Just holding made %.2f%% after the split, trading made %.2f%%."
DECAY = "A trade made %.2f%% before the split and only %.2f%% after it."
FALL = "Deepest fall after the split: %.2f%%."
FEW = "%d trades on both sides of the split are few to judge by."
NEEDS = f"A verdict needs {MIN_TRADES} out-of-sample trades or more; there are %d."
HELD = "Held up out of sample; simulated results promise no profit."
QUIET = "No clear edge out of sample: the small average %s is within noise."
LOST = "Out of sample the average trade lost money."
WEAK = "Profitable out of sample, but too weak or too uneven to rely on."
NO_CLAIM = "No win rate was claimed."
UNTESTED_CLAIM = "Too few trades after the split to test the claim."
CLAIM_MET = "Claim met: %.1f%% of the trades after the split won, where %.1f%% were claimed."
CLAIM_MISSED = "Claim missed: %.1f%% of the trades after the split won, where %.1f%% were claimed."


def grade(trades: Column, expectancy: Column, profit_factor: Column, is_expectancy: Column) -> Column:
    kept = (is_expectancy <= 0) | (expectancy >= RETENTION * is_expectancy)
    good = (profit_factor.isNull() | (profit_factor >= PROFIT_FACTOR)) & kept
    return F.when(trades < MIN_TRADES, "not_enough_data").when(expectancy <= 0, "fails").when(good, "holds").otherwise("fragile")


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def noise(trades: Column, expectancy: Column, stdev: Column) -> tuple[Column, Column]:
    """(outside noise, softened): NULL below ten trades; softened where the average is under one standard error."""
    error = stdev / F.sqrt(trades)
    enough = trades >= MIN_NOISE
    return F.when(enough, F.abs(expectancy) > 2 * error), F.when(enough, F.abs(expectancy) < error)


def reasons(p: str = "oos_", q: str = "is_") -> Column:
    """The ordered reasons: the summary, noise, lag behind holding, decay, drawdown, small sample."""
    c = lambda n: F.col(p + n)
    before, after = F.col(q + "expectancy_pct"), c("expectancy_pct")
    outside, _ = noise(c("trades"), after, c("expectancy_stdev_pct"))
    error = c("expectancy_stdev_pct") / F.sqrt(c("trades"))
    total = F.col(q + "trades") + c("trades")
    told = F.array(
        F.when(c("trades").isNotNull(), F.format_string(SUMMARY, c("trades"), after, F.when(c("profit_factor").isNull(), NONE_LOST).otherwise(_two(c("profit_factor"))))),
        F.when(outside, F.format_string(OUTSIDE_NOISE, after)).when(~outside, F.format_string(WITHIN_NOISE, c("trades"), after, error)),
        F.when(c("total_return_pct") < c("buy_and_hold_pct"), F.format_string(LAG, c("buy_and_hold_pct"), c("total_return_pct"))),
        F.when((before > 0) & (after < RETENTION * before), F.format_string(DECAY, before, after)),
        F.when(c("max_drawdown_pct").isNotNull(), F.format_string(FALL, c("max_drawdown_pct"))),
        F.when(total < SMALL_SAMPLE, F.format_string(FEW, total)),
    )
    return F.filter(told, lambda x: x.isNotNull())


def headline(grade: Column, trades: Column, expectancy: Column, softened: Column) -> Column:
    """One sentence on a grade; where the average is within one standard error of zero it says so instead of naming a gain or a loss."""
    return (
        F.when(grade == "not_enough_data", F.format_string(NEEDS, trades))
        .when(grade == "holds", HELD)
        .when(softened, F.format_string(QUIET, F.when(expectancy > 0, "gain").otherwise("loss")))
        .when(grade == "fails", LOST)
        .otherwise(WEAK)
    )


def side_by_side(split: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run with the figures of both parts as is_* and oos_*."""
    names = [c for c in split.columns if c not in (*keys, "part")]
    return split.groupBy(*keys).agg(*(F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{p}{c}") for part, p in (("IS", "is_"), ("OOS", "oos_")) for c in names))


def verdicts(split: DataFrame, keys: list[str], failed: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(keys, grade, headline, softened, reasons); runs of ``failed`` (keys, n) could not be split, those of ``errors`` (keys, error) have no grade."""
    wide = side_by_side(split, keys)
    _, soft = noise(F.col("oos_trades"), F.col("oos_expectancy_pct"), F.col("oos_expectancy_stdev_pct"))
    graded = wide.withColumn("grade", grade(F.col("oos_trades"), F.col("oos_expectancy_pct"), F.col("oos_profit_factor"), F.col("is_expectancy_pct"))).withColumn("softened", F.coalesce(soft, F.lit(False)))
    out = graded.select(*keys, "grade", headline(F.col("grade"), F.col("oos_trades"), F.col("oos_expectancy_pct"), F.col("softened")).alias("headline"), "softened", reasons().alias("reasons"))
    if errors is not None:
        told = F.concat(F.lit("The run ended early: "), F.col("error"), F.lit("."))
        out = out.unionByName(errors.select(*keys, F.lit(None).cast("string").alias("grade"), told.alias("headline"), F.lit(False).alias("softened"), F.array(told).alias("reasons")))
    if failed is None:
        return out
    text = F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(" candles, too few to split."))
    return out.unionByName(failed.select(*keys, F.lit("not_enough_data").alias("grade"), text.alias("headline"), F.lit(False).alias("softened"), F.array(text).alias("reasons")))


def market_list(requests: DataFrame, default: list[str], most: int = 5) -> DataFrame:
    """(request_id, markets, error): the primary market, then the requested or default ones, without repeats, 2 to ``most``."""
    wanted = F.when(F.size(F.coalesce("requested", F.array().cast("array<string>"))) > 0, F.col("requested")).otherwise(F.array(*map(F.lit, default)))
    markets = F.array_distinct(F.concat(F.array("primary"), wanted))
    return requests.select("request_id", markets.alias("markets"), F.when(F.size(markets) < MIN_MARKETS, "too few markets").when(F.size(markets) > most, "too many markets").alias("error"))


def cross_market(graded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grade, holds, tested, requested, reasons, unchecked) over rows (keys, symbol, grade); a NULL grade could not be checked.

    reasons name the markets that decide the grade, from the worst kind on;
    both lists are in the order of names.
    """
    n = lambda g: F.count_if(F.col("grade") == g)
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("symbol").cast("string"))))
    kinds = ["fails", "fragile", "not_enough_data"]
    parts = graded.groupBy(*keys).agg(
        F.count("grade").alias("tested"), F.count("*").alias("requested"), *(n(g).alias(g) for g in ("holds", *kinds)),
        *(named(F.col("grade") == g).alias(f"{g}_in") for g in kinds), named(F.col("grade").isNull()).alias("unchecked"),
    )
    g = (
        F.when(F.col("tested") < MIN_MARKETS, "not_enough_data")
        .when(F.col("fails") > 0, "fails")
        .when(F.col("requested") > F.col("tested"), "fragile")
        .when(F.col("fragile") > 0, "fragile")
        .when(F.col("not_enough_data") > 0, F.when(F.col("holds") == 0, "not_enough_data").otherwise("fragile"))
        .otherwise("holds")
    )
    told = lambda names, text: F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(names, ", "), F.lit(".")))
    why = F.array(
        F.when(F.col("tested") < MIN_MARKETS, F.concat(F.lit("Markets checked: "), F.col("tested").cast("string"), F.lit("; at least two are needed."))),
        told("fails_in", "Fails on "), told("unchecked", "Could not be checked: "), told("fragile_in", "Fragile on "), told("not_enough_data_in", "Too few trades on "),
        F.when(F.col("holds") > 0, F.concat(F.lit("Holds on "), F.col("holds").cast("string"), F.lit(" of "), F.col("requested").cast("string"), F.lit(" markets."))),
    )
    return parts.select(*keys, g.alias("grade"), "holds", "tested", "requested", F.filter(why, lambda x: x.isNotNull()).alias("reasons"), "unchecked")


def requested(asked: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """Every run of ``asked`` (keys, with symbol and interval), with its grade and why it has none: NULL grades are unchecked in a vote."""
    rows = asked.select(*keys).distinct().join(graded.withColumn("_there", F.lit(True)), keys, "left")
    reason = F.when(F.col("_there").isNull(), F.concat(F.lit("no candles of "), F.col("symbol"), F.lit(" in "), F.col("interval"))).when(F.col("grade").isNull(), "the run failed")
    return rows.withColumn("unchecked_reason", reason).drop("_there")


def timeframe_cells(rows: DataFrame) -> DataFrame:
    """Rows (…, trades, win_rate_pct, profit_factor, expectancy_pct, grade) with figures hidden below thirty trades."""
    shown = F.col("trades") >= MIN_TRADES
    return rows.withColumns({c: F.when(shown, F.col(c)) for c in ("win_rate_pct", "profit_factor", "expectancy_pct")})


def timeframe_table(split: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """(keys, trades, win_rate_pct, profit_factor, expectancy_pct, grade, label): the later part of each run; ``keys`` hold the timeframe.

    Runs of ``failed`` have a grade and no figures.
    """
    figures = ["trades", "win_rate_pct", "profit_factor", "expectancy_pct"]
    graded = verdicts(split, keys, failed).select(*keys, "grade")
    rows = timeframe_cells(graded.join(split.where("part = 'OOS'").select(*keys, *figures), keys, "left"))
    few = F.concat(F.lit("Too few trades ("), F.col("trades").cast("string"), F.lit(")"))
    return rows.select(*keys, *figures, "grade", F.when(F.col("trades") < MIN_TRADES, few).otherwise(F.replace("grade", F.lit("_"), F.lit(" "))).alias("label"))


def weak_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weak): two rows or more and exactly one of them holds."""
    return rows.groupBy(*keys).agg(((F.count("*") >= 2) & (F.count_if(F.col("grade") == "holds") == 1)).alias("weak"))


def compare_claim(claimed: Column, rate: Column) -> tuple[Column, Column]:
    """(held, sentence) of a claimed win rate against that of the trades after the split."""
    held = F.when(claimed.isNotNull() & rate.isNotNull(), rate >= claimed)
    told = F.when(held, F.format_string(CLAIM_MET, rate, claimed)).otherwise(F.format_string(CLAIM_MISSED, rate, claimed))
    return held, F.when(claimed.isNull(), NO_CLAIM).when(rate.isNull(), UNTESTED_CLAIM).otherwise(told)
