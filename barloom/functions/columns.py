"""Column expressions of the rules that need no other row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000
# The timeframes, their step in milliseconds and bars a year.
INTERVALS = [("1m", 60_000, 525_600), ("5m", 300_000, 105_120), ("15m", 900_000, 35_040), ("1h", 3_600_000, 8_760), ("4h", 14_400_000, 2_190), ("1d", 86_400_000, 365)]


def lookup(col: Column, pairs: dict) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out


def step_ms(interval: Column) -> Column:
    return lookup(interval, {k: s for k, s, _ in INTERVALS}).cast("long")


def bars_per_year(interval: Column) -> Column:
    return lookup(interval, {k: b for k, _, b in INTERVALS}).cast("long")


def interval_table(df: DataFrame, interval: str = "interval") -> DataFrame:
    """``df`` with step_ms and bars_per_year; NULL for unknown intervals. The six-row table is broadcast."""
    rows = df.sparkSession.createDataFrame(INTERVALS, "_i string, step_ms long, bars_per_year long")
    return df.join(F.broadcast(rows), F.col(interval) == F.col("_i"), "left").drop("_i")


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike("^[A-Z0-9]{2,20}$"), F.lit(False))


def align_start(ts: Column, step: Column) -> Column:
    return ts - F.pmod(ts, step)


def minute_of_day(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(DAY)) / 60_000).cast("int")


def day_id(ts: Column) -> Column:
    return ((ts - F.pmod(ts, F.lit(DAY))) / DAY).cast("long")


def in_session(ts: Column, open_minute: int, close_minute: int) -> Column:
    """The minute of the UTC day is in [open, close), over midnight if open > close."""
    if not (0 <= open_minute < 1440 and 0 <= close_minute <= 1440 and open_minute != close_minute):
        raise ValueError("a session needs two different minutes of a day")
    m = minute_of_day(ts)
    after, before = m >= open_minute, m < close_minute
    return (after & before) if open_minute < close_minute else (after | before)


def bar_count(start: Column, end: Column, step: Column) -> Column:
    return F.floor((end - start) / step).cast("long") + 1


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def round_to_tick(price: Column, tick: Column) -> Column:
    """Half away from zero."""
    return F.signum(price) * F.floor(F.abs(price) / tick + 0.5) * tick


def position_size(equity: Column, price: Column, risk_pct: Column, stop_pct: Column) -> Column:
    """Units to hold; NULL where the equity, price, risk or stop is not a finite number above 0."""
    good = finite(equity) & finite(price) & finite(risk_pct) & finite(stop_pct) & (equity > 0) & (price > 0) & (risk_pct > 0) & (stop_pct > 0)
    return F.when(good, equity * risk_pct / 100 / (price * stop_pct / 100))


def trade_return_pct(sign: Column, entry: Column, exit_: Column, cost: Column, factor: Column | float = 1.0) -> Column:
    """Return of a proportional position in per cent: price move less costs on both ends, free of the equity."""
    ratio = exit_ / entry
    return 100 * F.lit(factor) * (sign * (ratio - 1) - cost * (1 + ratio))


def bracket_levels(sign: Column, entry: Column, stop_pct: Column, target_pct: Column, trail_pct: Column) -> list[Column]:
    """Stop, target and first trailing level; NULL where a percentage is."""
    return [entry * (1 - sign * stop_pct / 100), entry * (1 + sign * target_pct / 100), entry * (1 - sign * trail_pct / 100)]


def order_fill_price(kind: Column, side: Column, price: Column, open_: Column, high: Column, low: Column) -> Column:
    """The price at which an order fills on a bar, NULL while it rests; a gap fills at the open.

    A buy limit and a sell stop wait for lower prices, a sell limit and a buy
    stop for higher ones.
    """
    falls = ((kind == "limit") & (side == "buy")) | ((kind == "stop") & (side == "sell"))
    rises = ((kind == "limit") & (side == "sell")) | ((kind == "stop") & (side == "buy"))
    return (
        F.when(kind == "market", open_)
        .when(falls, F.when(open_ <= price, open_).when(low <= price, price))
        .when(rises, F.when(open_ >= price, open_).when(high >= price, price))
    )


def resolve_exit(sign: Column, open_: Column, high: Column, low: Column, stop: Column, target: Column, trail: Column, trail_before: Column) -> tuple[Column, Column]:
    """(price, reason) of the exit that a bar forces, NULL if none.

    The tighter of the fixed and the trailing stop holds, a tie counts as
    trailing. A stop gap is judged by the trailing level before this bar and
    fills at the open; so does a target gap, which alone beats a stop.
    """
    tighter = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.when(sign > 0, F.greatest(a, b)).otherwise(F.least(a, b)))
    level, before = tighter(stop, trail), tighter(stop, trail_before)
    trailing = trail.isNotNull() & (stop.isNull() | (sign * trail >= sign * stop))
    trailing_before = trail_before.isNotNull() & (stop.isNull() | (sign * trail_before >= sign * stop))
    low_side, high_side = F.when(sign > 0, low).otherwise(high), F.when(sign > 0, high).otherwise(low)
    stop_gap = sign * open_ <= sign * before
    stop_hit = sign * low_side <= sign * level
    target_gap = sign * open_ >= sign * target
    target_hit = sign * high_side >= sign * target
    name = lambda t: F.when(t, F.lit("Trailing")).otherwise(F.lit("StopLoss"))
    price = F.when(stop_gap, open_).when(target_gap, open_).when(stop_hit, level).when(target_hit, target)
    reason = F.when(stop_gap, name(trailing_before)).when(target_gap, "TakeProfit").when(stop_hit, name(trailing)).when(target_hit, "TakeProfit")
    return price, reason
