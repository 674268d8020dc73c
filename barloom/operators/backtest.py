"""Trades and equity of a strategy on many series at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import DAY, in_session
from barloom.operators.clean import SERIES
from barloom.operators.rules import eval_rules

TRADE = "trade_no int, entry_idx int, exit_idx int, entry_ts long, exit_ts long, side string, entry_price double, exit_price double, return_pct double, reason string, error string"
TRADE_NAMES = [c.split()[0] for c in TRADE.split(", ")]


def _after(positions: np.ndarray, at: int) -> int | None:
    """The first of sorted positions that is not before ``at``."""
    i = int(np.searchsorted(positions, at))
    return int(positions[i]) if i < len(positions) else None


def first_forced_exit(o: np.ndarray, h: np.ndarray, lo: np.ndarray, start: int, sign: int, entry: float, stop_pct: float | None, target_pct: float | None, trail_pct: float | None) -> tuple[int, float, str] | None:
    """(bar, price, reason) of the first bar from ``start`` on that a stop, trail or target ends, looked for in growing blocks."""
    if stop_pct is None and target_pct is None and trail_pct is None:
        return None
    stop = entry * (1 - sign * stop_pct / 100) if stop_pct is not None else -sign * np.inf
    target = entry * (1 + sign * target_pct / 100) if target_pct is not None else sign * np.inf
    best, level_before, size, a = entry, None, 64, start
    if trail_pct is not None:
        level_before = round(entry * (1 - sign * trail_pct / 100), 12)
    while a < len(o):
        b = min(len(o), a + size)
        opens, near, far = o[a:b], (lo if sign > 0 else h)[a:b], (h if sign > 0 else lo)[a:b]
        if trail_pct is None:
            level = before = np.full(b - a, stop)
            trailing = trailing_before = np.zeros(b - a, bool)
        else:
            peak = (np.maximum if sign > 0 else np.minimum).accumulate(np.concatenate([[best], far]))[1:]
            trail = np.round(peak * (1 - sign * trail_pct / 100), 12)
            trail_before = np.concatenate([[level_before], trail[:-1]])
            trailing, trailing_before = sign * trail >= sign * stop, sign * trail_before >= sign * stop
            level, before = np.where(trailing, trail, stop), np.where(trailing_before, trail_before, stop)
            best, level_before = peak[-1], trail[-1]
        gap_stop, gap_target = sign * opens <= sign * before, sign * opens >= sign * target
        hit = gap_stop | gap_target | (sign * near <= sign * level) | (sign * far >= sign * target)
        if hit.any():
            k = int(hit.argmax())
            name = lambda t: "Trailing" if t else "StopLoss"
            if gap_stop[k]:
                return a + k, float(opens[k]), name(trailing_before[k])
            if gap_target[k]:
                return a + k, float(opens[k]), "TakeProfit"
            if sign * near[k] <= sign * level[k]:
                return a + k, float(level[k]), name(trailing[k])
            return a + k, float(target), "TakeProfit"
        a, size = b, size * 2
    return None


def scan_trades(
    bars: pd.DataFrame,
    entry: np.ndarray,
    exit_: np.ndarray,
    side: str | np.ndarray = "long",
    *,
    stop_pct: float | None = None,
    target_pct: float | None = None,
    trail_pct: float | None = None,
    session: np.ndarray | None = None,
    exit_at_session_end: bool = False,
    cost: float = 0.0007,
    factor: float = 1.0,
    tick: float = 1e-9,
    rearm: bool = True,
    fills_per_day: int | None = None,
    start: int = 0,
    armed: bool = True,
    equity: float = 1.0,
    most: int | None = None,
) -> pd.DataFrame:
    """Non-overlapping trades of one sorted series; jumps from trade to trade, not from bar to bar.

    ``most`` ends the scan after so many trades; ``start``, ``armed`` (false: a flat
    bar without the entry rule must come first) and ``equity`` take one up again.

    A signal on a bar's close fills at the next open. After a trade the next
    entry needs a flat bar, from the closing one on, on which the entry rule is
    false. On one bar a signalled exit comes first, then stop, trail and
    target, then the session's end. A run whose equity is used up before a next
    entry, or that would enter at a price of 0 or less, is one row with error.
    """
    ts, o, h, lo, c = (bars[x].to_numpy() for x in ("ts", "open", "high", "low", "close"))
    n = len(ts)
    inside = np.ones(n, bool) if session is None else np.asarray(session, bool)
    seen = inside & (np.arange(n) < n - 1)
    wants, lacks = np.flatnonzero(seen & entry), np.flatnonzero(seen & ~entry)
    exits = np.flatnonzero(exit_ & (np.arange(n) < n - 1))
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) if exit_at_session_end else np.zeros(0, int)
    rows, at, fills = [], start, {}
    if rearm and not armed:
        flat = _after(lacks, at)
        at = n if flat is None else flat + 1
    while most is None or len(rows) < most:
        signal = _after(wants, at)
        if signal is None:
            break
        day = int(ts[signal]) // DAY
        if not inside[signal + 1] or (fills_per_day is not None and fills.get(day, 0) >= fills_per_day):
            at = signal + 1
            continue
        first = signal + 1
        price = float(np.sign(o[first]) * np.floor(abs(o[first]) / tick + 0.5) * tick) if tick > 1e-9 else float(o[first])
        if equity <= 0 or price <= 0:
            return pd.DataFrame([[None] * 10 + ["equity used up" if equity <= 0 else "bad entry price"]], columns=TRADE_NAMES)
        name = side if isinstance(side, str) else side[signal]
        sign = 1 if name == "long" else -1
        filled = int(ts[first]) // DAY
        fills[filled] = fills.get(filled, 0) + 1
        flagged = _after(exits, first)
        by_rule = n if flagged is None else flagged + 1
        forced = first_forced_exit(o, h, lo, first, sign, price, stop_pct, target_pct, trail_pct)
        by_end = _after(ends, first)
        by_end = n if by_end is None else by_end
        by_force = n if forced is None else forced[0]
        if by_rule < n and by_rule <= min(by_force, by_end):
            last, out, reason = by_rule, float(o[by_rule]), "Signal"
        elif by_force < n and by_force <= by_end:
            last, out, reason = forced
        elif by_end < n:
            last, out, reason = by_end, float(c[by_end]), "SessionEnd"
        else:
            last, out, reason = n - 1, float(c[-1]), "EndOfData"
        ratio = out / price
        gain = factor * (sign * (ratio - 1) - cost * (1 + ratio))
        equity *= 1 + gain
        rows.append((len(rows), first, last, int(ts[first]), int(ts[last]), name, price, out, 100 * gain, reason, None))
        if not rearm:
            at = last
            continue
        flat = _after(lacks, last)
        if flat is None:
            break
        at = flat + 1
    return pd.DataFrame(rows, columns=TRADE_NAMES)


def backtest_trades(flagged: DataFrame, keys: list[str] | None = None, side: str = "long", **rules: object) -> DataFrame:
    """Trades of each run key; ``flagged`` has ts, prices, entry, exit_ and, if used, side and session_ok.

    A run key is one group: its bars fit one task, and keys run in parallel.
    """
    keys = keys or SERIES
    kinds = {f.name: f.dataType.simpleString() for f in flagged.schema}
    has_side, has_session = "side" in kinds, "session_ok" in kinds

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        found = scan_trades(
            group, group["entry"].to_numpy(bool), group["exit_"].to_numpy(bool), group["side"].to_numpy() if has_side else side, session=group["session_ok"].to_numpy(bool) if has_session else None, **rules
        )
        for k in reversed(keys):
            found.insert(0, k, group[k].iloc[0])
        return found

    used = [*keys, "ts", "open", "high", "low", "close", "entry", "exit_", *(["side"] if has_side else []), *(["session_ok"] if has_session else [])]
    return flagged.select(used).groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), TRADE]))


def run_strategy(candles: DataFrame, strategy: dict, fee_bps: float = 5.0, slippage_bps: float = 2.0, session: tuple[int, int] | None = None, **rules: object) -> DataFrame:
    """Trades of one strategy on every series of ``candles``."""
    flagged = eval_rules(candles, strategy)
    if session:
        flagged = flagged.withColumn("session_ok", in_session(F.col("ts"), *session))
    return backtest_trades(flagged, side=strategy["side"], stop_pct=strategy.get("stop_loss_pct"), target_pct=strategy.get("take_profit_pct"), cost=(fee_bps + slippage_bps) / 1e4, **rules)


class Strategy:
    """What a user's own strategy with a state offers; one is made for each series."""

    def signals(self, bars: pd.DataFrame, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | str]:
        """(entry, exit, side) of all bars, of which those from ``start`` on count, as far as is known before the next fill."""
        raise NotImplementedError

    def filled(self, bars: pd.DataFrame, at: int, side: str) -> None:
        """An entry was filled at bar ``at``; signals are asked for again, from the trade's exit on."""


def scan_stateful(bars: pd.DataFrame, strategy: Strategy, rearm: bool = True, **rules: object) -> pd.DataFrame:
    """``scan_trades`` of a strategy with a state: it is told of each fill and asked anew after each trade.

    Exit signals of a trade are those that the strategy gave before its fill.
    """
    found, at, equity = [], 0, 1.0
    while at < len(bars):
        entry, exit_, side = strategy.signals(bars, at)
        one = scan_trades(bars, np.asarray(entry, bool), np.asarray(exit_, bool), side, rearm=rearm, start=at, armed=not found, equity=equity, most=1, **rules)
        if not len(one):
            break
        trade = one.iloc[0]
        if isinstance(trade["error"], str):
            return one
        found.append(one.assign(trade_no=len(found)))
        strategy.filled(bars, int(trade["entry_idx"]), trade["side"])
        at, equity = int(trade["exit_idx"]), equity * (1 + float(trade["return_pct"]) / 100)
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=TRADE_NAMES)


def stateful_trades(candles: DataFrame, make: Callable[[], Strategy], keys: list[str] | None = None, **rules: object) -> DataFrame:
    """Trades of a user's strategy with a state on every series; ``make`` makes one for each."""
    keys = keys or SERIES

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts").reset_index(drop=True)
        found = scan_stateful(group, make(), **rules)
        for k in reversed(keys):
            found.insert(0, k, group[k].iloc[0])
        return found

    kinds = {f.name: f.dataType.simpleString() for f in candles.schema}
    return candles.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), TRADE]))


def equity_curve(candles: DataFrame, trades: DataFrame, keys: list[str] | None = None, cost: float = 0.0007, factor: float = 1.0, start: float = 1.0) -> DataFrame:
    """(keys, idx, ts, open, close, equity) of every bar: realised while flat, marked to the close less costs while open.

    A bar's equity hangs on the last trade that began by then, so each trade is
    joined to its entry bar alone and carried on by a window; what is realised is
    a running product in the order of trades. Runs that ended in an error have no
    curve.
    """
    keys = keys or SERIES
    failed = trades.where("error is not null").select(*keys).distinct()
    run = Window.partitionBy(*keys).orderBy("trade_no")
    grow = 1 + F.col("return_pct") / 100
    good = trades.where("error is null and trade_no is not null")
    done = good.withColumn("after", F.product(grow).over(run.rowsBetween(Window.unboundedPreceding, 0)) * start).withColumn("before", F.coalesce(F.lag("after").over(run), F.lit(start)))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    began = done.select(*keys, F.col("entry_idx").alias("idx"), F.struct("trade_no", "exit_idx", "entry_price", sign.alias("sign"), "before", "after").alias("t"))
    # made-up trades may begin on one bar: the later one tells its equity
    began = began.groupBy(*keys, "idx").agg(F.max("t").alias("t"))
    bars = candles.select(*keys, "ts", "open", "close").join(failed, keys, "left_anti").withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1).cast("int"))
    marked = bars.join(began, [*keys, "idx"], "left").withColumn("t", F.last("t", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    ratio = F.col("close") / F.col("t.entry_price")
    own = F.when(F.col("idx") < F.col("t.exit_idx"), F.col("t.before") * (1 + factor * (F.col("t.sign") * (ratio - 1) - cost * (1 + ratio)))).otherwise(F.col("t.after"))
    return marked.select(*keys, "idx", "ts", "open", "close", F.coalesce(own, F.lit(start)).alias("equity"))


def trailing_levels(path: DataFrame, trail_pct: float, digits: int | None = 12) -> DataFrame:
    """``path`` (trade, idx, sign, entry_price, high, low) with peak, level and level_before of a trailing stop; levels are rounded to ``digits`` (None: not at all)."""
    w = Window.partitionBy("trade").orderBy("idx")
    sign = F.col("sign")
    high, low = F.max("high").over(w), F.min("low").over(w)
    peak = F.when(sign > 0, F.greatest(high, "entry_price")).otherwise(F.least(low, "entry_price"))
    exact = lambda p: p * (1 - sign * trail_pct / 100)
    level = exact if digits is None else lambda p: F.round(exact(p), digits)
    out = path.withColumn("peak", peak).withColumn("level", level(F.col("peak")))
    return out.withColumn("level_before", F.coalesce(F.lag("level").over(w), level(F.col("entry_price"))))


def validate_instruments(instruments: DataFrame) -> DataFrame:
    """Instruments (symbol, tick_size, point_value, fee_bps, slippage_bps) with error, NULL if valid."""
    from barloom.functions.columns import finite

    positive = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    cost = lambda c: finite(F.col(c)) & F.col(c).between(0, 1000)
    error = F.when(F.coalesce(F.col("symbol"), F.lit("")) == "", "symbol is empty")
    for test, name in ((positive, "tick_size"), (positive, "point_value"), (cost, "fee_bps"), (cost, "slippage_bps")):
        error = error.when(~test(name), f"bad {name}")
    return instruments.withColumn("error", error)


def custom_flags(candles: DataFrame, entry_side: Column, exit_flag: Column) -> DataFrame:
    """``candles`` with the flags of a user's own rule: entry_side 'long', 'short' or NULL, and exit_flag."""
    return candles.withColumns({"entry": entry_side.isNotNull(), "side": F.coalesce(entry_side, F.lit("long")), "exit_": F.coalesce(exit_flag, F.lit(False))})
