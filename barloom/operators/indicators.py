"""Causal indicators of each series; NULL while they warm up.

Moving averages and crosses are window functions. EMA, RSI and ATR are linear
recurrences: a series is one group of a pandas helper, which is bounded by the
length of one series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import DAY
from barloom.operators.clean import SERIES, by_time


def with_idx(candles: DataFrame) -> DataFrame:
    """``candles`` with idx, the bar's number in its series from 0."""
    return candles.withColumn("idx", (F.row_number().over(by_time()) - 1).cast("int"))


def sma(x: Column, n: int, order: Window | None = None) -> Column:
    w = order or by_time()
    if n < 1:
        return F.lit(None).cast("double")
    return F.when(F.row_number().over(w) >= n, F.avg(x).over(w.rowsBetween(1 - n, 0)))


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    span = F.col("high") - F.col("low")
    return F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def seeded_ewm(x: np.ndarray, n: int, alpha: float, start: int = 0) -> np.ndarray:
    """NaN before start + n - 1, there the mean of the first n values, then x * alpha + previous * (1 - alpha)."""
    out = np.full(len(x), np.nan)
    first = start + n - 1
    if n >= 1 and first < len(x):
        tail = np.concatenate([[x[start : first + 1].mean()], x[first + 1 :]])
        out[first:] = pd.Series(tail).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def ema_values(x: np.ndarray, n: int) -> np.ndarray:
    return seeded_ewm(x, n, 2 / (n + 1)) if n >= 1 else np.full(len(x), np.nan)


def rsi_values(x: np.ndarray, n: int) -> np.ndarray:
    if n < 1 or len(x) <= n:
        return np.full(len(x), np.nan)
    move = np.diff(x, prepend=x[:1])
    gain = seeded_ewm(np.maximum(move, 0), n, 1 / n, 1)
    loss = seeded_ewm(np.maximum(-move, 0), n, 1 / n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100 - 100 / (1 + gain / loss)
    return np.where(np.isnan(gain), np.nan, np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), value))


def indicator_values(bars: pd.DataFrame, kind: str, n: int | None) -> np.ndarray:
    """One indicator over a sorted series, NaN where missing."""
    if kind in ("open", "high", "low", "close"):
        return bars[kind].to_numpy()
    close = bars["close"].to_numpy()
    if kind == "sma":
        return pd.Series(close).rolling(n).mean().to_numpy() if n >= 1 else np.full(len(close), np.nan)
    if kind == "ema":
        return ema_values(close, n)
    if kind == "rsi":
        return rsi_values(close, n)
    if kind == "atr":
        before = np.concatenate([[np.nan], close[:-1]])
        high, low = bars["high"].to_numpy(), bars["low"].to_numpy()
        span = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        return seeded_ewm(span, n, 1 / n) if n >= 1 else np.full(len(close), np.nan)
    raise ValueError(f"unknown indicator {kind}")


def with_recurrences(candles: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """``candles`` with one column kind_n for each (kind, n) of ema, rsi and atr, all in one pass over a series; a missing value is NULL."""
    names = [f"{k}_{n}" for k, n in wanted]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        return group.assign(**{name: indicator_values(group, k, n) for name, (k, n) in zip(names, wanted, strict=True)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in candles.schema), *(f"{n} double" for n in names)])
    return candles.groupBy(*SERIES).applyInPandas(run, schema)


def crosses(left: Column, right: Column, above: bool, order: Window | None = None) -> Column:
    """Whether left passed right between the bar before and this one; false where one of the four values is missing."""
    w = order or by_time()
    l0, r0 = F.lag(left).over(w), F.lag(right).over(w)
    hit = (l0 <= r0) & (left > right) if above else (l0 >= r0) & (left < right)
    return F.coalesce(hit, F.lit(False))


def opening_range_breakout(candles: DataFrame, k: int, buffer_pct: float) -> DataFrame:
    """``candles`` with range_high, range_low of the day's first k bars and side: 'long', 'short' or NULL on the later ones."""
    day = F.floor(F.col("ts") / DAY)
    whole = Window.partitionBy(*SERIES, "_day")
    out = candles.withColumn("_day", day).withColumn("_n", F.row_number().over(whole.orderBy("ts")))
    early = F.col("_n") <= k
    out = out.withColumn("range_high", F.max(F.when(early, F.col("high"))).over(whole)).withColumn("range_low", F.min(F.when(early, F.col("low"))).over(whole))
    side = F.when(~early & (F.col("close") > F.col("range_high") * (1 + buffer_pct / 100)), "long").when(~early & (F.col("close") < F.col("range_low") * (1 - buffer_pct / 100)), "short")
    return out.withColumn("side", side).drop("_day", "_n")
