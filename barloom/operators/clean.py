"""Cleaning and checking of candles and run requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import bar_count, finite, step_ms

SERIES = ["symbol", "interval"]
FIVE_YEARS = 5 * 365 * 86_400_000


def by_time() -> Window:
    return Window.partitionBy(*SERIES).orderBy("ts")


def normalise_candles(candles: DataFrame, start: int | None = None, end: int | None = None, order: str = "arrival") -> DataFrame:
    """Bars in the inclusive range, one for each time: the first to arrive."""
    if start is not None:
        candles = candles.where(F.col("ts") >= start)
    if end is not None:
        candles = candles.where(F.col("ts") <= end)
    first = F.row_number().over(Window.partitionBy(*SERIES, "ts").orderBy(order))
    return candles.withColumn("_n", first).where("_n = 1").drop("_n")


def drop_unclosed(candles: DataFrame, now: int, step: Column) -> DataFrame:
    return candles.where(F.col("ts") + step <= now)


def candle_fault(before: Column) -> Column:
    """The first rule that a bar breaks, NULL if none; ``before`` is the time of the bar before it."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    reason = F.when(before >= F.col("ts"), "timestamps are not ascending")
    for name in ("open", "high", "low", "close"):
        reason = reason.when(~finite(F.col(name)), f"{name} is not finite")
    return reason.when(h < low, "high is below low").when(h < F.greatest(o, c), "high is below open or close").when(low > F.least(o, c), "low is above open or close")


def validate_candles(candles: DataFrame) -> DataFrame:
    """``candles`` with idx and reason: the first rule that the bar breaks, NULL if none."""
    order = Window.partitionBy(*SERIES).orderBy("arrival") if "arrival" in candles.columns else by_time()
    return candles.withColumn("_before", F.lag("ts").over(order)).withColumn("idx", F.row_number().over(order) - 1).withColumn("reason", candle_fault(F.col("_before"))).drop("_before")


def find_gaps(candles: DataFrame) -> DataFrame:
    """(symbol, interval, prev_ts, ts) where neighbours are more than a step apart."""
    return candles.select(*SERIES, F.lag("ts").over(by_time()).alias("prev_ts"), "ts").where(F.col("ts") - F.col("prev_ts") > step_ms(F.col("interval")))


def range_limit(requests: DataFrame, cap: int = 100_000) -> DataFrame:
    """Requests (interval, start_ms, end_ms) with bars and within_cap."""
    n = bar_count(F.col("start_ms"), F.col("end_ms"), step_ms(F.col("interval")))
    return requests.withColumns({"bars": n, "within_cap": n <= cap})


def fit_range(candles: DataFrame, now: int, cap: int = 50_000) -> DataFrame:
    """The latest window of each series: the shorter of five years and cap bars, ending now."""
    span = F.least(F.lit(FIVE_YEARS), (cap - 1) * step_ms(F.col("interval")))
    return candles.where((F.col("ts") >= now - span) & (F.col("ts") <= now))


def latest_bars(candles: DataFrame, cap: int) -> DataFrame:
    """The last ``cap`` bars of each series."""
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ts")))
    return candles.withColumn("_n", newest).where(F.col("_n") <= cap).drop("_n")


def mark_days(candles: DataFrame) -> DataFrame:
    """``candles`` with day_id and is_new_day (the first bar of a series opens a day)."""
    from barloom.functions.columns import day_id

    day = day_id(F.col("ts"))
    before = F.lag(day).over(by_time())
    return candles.withColumns({"day_id": day, "is_new_day": before.isNull() | (before != day)})


def validate_run_params(requests: DataFrame, cap: int = 100_000) -> DataFrame:
    """Run requests (interval, start_ms, end_ms, fee_bps, slippage_bps, split) with defaults and error, NULL if valid."""
    fee, slip = F.coalesce("fee_bps", F.lit(5.0)), F.coalesce("slippage_bps", F.lit(2.0))
    step = step_ms(F.col("interval"))
    cost = lambda c: finite(c) & (c >= 0) & (c <= 1000)
    error = (
        F.when(step.isNull(), "unknown interval")
        .when(F.col("start_ms") >= F.col("end_ms"), "start must be before end")
        .when(bar_count(F.col("start_ms"), F.col("end_ms"), step) > cap, "too many bars")
        .when(~cost(fee), "bad fee")
        .when(~cost(slip), "bad slippage")
        .when(F.col("split").isNotNull() & ~(finite(F.col("split")) & (F.col("split") > 0) & (F.col("split") < 1)), "bad split")
    )
    return requests.withColumns({"fee_bps": fee, "slippage_bps": slip, "error": error})
