"""Registering queries with their SQL, and the parts of SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name; ``sql`` follows the CTEs of bars."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Hourly bars of events, with idx.
BARS = """
t AS (SELECT upper(event_type) AS symbol, epoch_ms(ts) AS ms, ts AS tm, event_id AS seq, value + 100 AS price FROM events),
c AS (
  SELECT symbol, '1h' AS interval, ms - ms % 3600000 AS ts, first(price ORDER BY tm, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY tm, seq) AS close
  FROM t GROUP BY symbol, ms - ms % 3600000),
b AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::INTEGER AS idx FROM c)
"""

#: Trades that last from bar 10 k + 1 (open) to bar 10 k + 6 (close), long for even k, and the curve of their equity.
COST = 0.0007
TRADES = (
    BARS
    + f""",
tr0 AS (
  SELECT e.symbol, e.interval, (e.idx - 1) // 10 AS trade_no, e.idx AS entry_idx, x.idx AS exit_idx, e.ts AS entry_ts, x.ts AS exit_ts,
         CASE WHEN ((e.idx - 1) // 10) % 2 = 0 THEN 'long' ELSE 'short' END AS side, e.open AS entry_price, x.close AS exit_price
  FROM b e JOIN b x ON e.symbol = x.symbol AND x.idx = e.idx + 5 WHERE e.idx % 10 = 1),
tr AS (
  SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sign,
         100 * ((CASE WHEN side = 'long' THEN 1 ELSE -1 END) * (exit_price / entry_price - 1) - {COST}::DOUBLE * (1 + exit_price / entry_price)) AS return_pct
  FROM tr0),
td AS (
  SELECT *, coalesce(product(1 + return_pct / 100) OVER (PARTITION BY symbol ORDER BY trade_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS before FROM tr),
eq AS (
  SELECT b.symbol, b.interval, b.idx, b.ts, b.open, b.close,
         CASE WHEN o.trade_no IS NOT NULL THEN o.before * (1 + o.sign * (b.close / o.entry_price - 1) - {COST}::DOUBLE * (1 + b.close / o.entry_price))
              ELSE coalesce((SELECT max_by(z.before * (1 + z.return_pct / 100), z.trade_no) FROM td z WHERE z.symbol = b.symbol AND z.exit_idx <= b.idx), 1.0) END AS equity
  FROM b LEFT JOIN td o ON o.symbol = b.symbol AND b.idx >= o.entry_idx AND b.idx < o.exit_idx)
"""
)


def trades_sql(flags: str, keys: str = "symbol", stop: str = "NULL", target: str = "NULL", rearm: bool = True, once_a_day: bool = False, trail: str | None = None, session: bool = False) -> str:
    """CTEs up to ``tx``, the trades of each run, made bar by bar by a recursive query.

    ``flags`` are CTEs up to f (keys, idx, n, ts, open, high, low, close, entry,
    exit_, sign). The state after a bar: want (enter at the next open), the open
    trade (ei, ep, sg), leave (exit at the next open), armed, the day of the last
    fill, and what ended on this bar (reason, xp). ``stop`` and ``target`` are
    percentages as SQL over f. With ``trail`` the state has the best price of the
    open trade and the trail's last level; with ``session`` f has ok, whether a
    bar is in session, and fin, whether it is a session's last, which ends trades.
    """
    on = " AND ".join(f"f.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    f_keys = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    opens, ok, fin = ("(r.want AND f.ok)", " AND f.ok", " WHEN f.fin THEN 'SessionEnd'") if session else ("r.want", "", "")
    # what a bar is held against at its open and later, and the name of what ends the trade there
    before, level, by_open, by_low, state, more, told = "sl", "sl", "'StopLoss'", "'StopLoss'", "", "", ""
    if trail is not None:
        at = lambda p: f"round({p} * (1 - s1 * ({trail}) / 100), 12)"
        fixed = "coalesce(sl, -s1 * 1e300)"
        more = f"""
      CASE WHEN s1 > 0 THEN greatest(CASE WHEN {opens} THEN p1 ELSE r.pk END, f.high) ELSE least(CASE WHEN {opens} THEN p1 ELSE r.pk END, f.low) END AS pk1, CASE WHEN {opens} THEN {at("p1")} ELSE r.lv END AS lv0, {at("pk1")} AS lv1,
      CASE WHEN s1 * lv0 >= s1 * {fixed} THEN lv0 ELSE {fixed} END AS before, CASE WHEN s1 * lv1 >= s1 * {fixed} THEN lv1 ELSE {fixed} END AS level, CASE WHEN s1 * lv0 >= s1 * {fixed} THEN 'Trailing' ELSE 'StopLoss' END AS by_open, CASE WHEN s1 * lv1 >= s1 * {fixed} THEN 'Trailing' ELSE 'StopLoss' END AS by_low,"""
        before, level, by_open, by_low, state, told = "before", "level", "by_open", "by_low", ", NULL::DOUBLE AS pk, NULL::DOUBLE AS lv", ", CASE WHEN why IS NULL THEN pk1 END, CASE WHEN why IS NULL THEN lv1 END"
    stops = "'StopLoss', 'Trailing'" if trail is not None else "'StopLoss'"
    free = f"f.entry{ok} AND f.idx < f.n - 1{' AND coalesce(f.ts // 86400000 <> fday, true)' if once_a_day else ''}"
    return f"""{flags},
r AS (
  SELECT {keys}, -1 AS idx, false AS want, NULL::INTEGER AS ei, NULL::DOUBLE AS ep, NULL::INTEGER AS sg, NULL::INTEGER AS nsg, false AS leave, true AS armed, NULL::BIGINT AS day, NULL::VARCHAR AS reason, NULL::DOUBLE AS xp, NULL::INTEGER AS oi, NULL::DOUBLE AS op, NULL::INTEGER AS og{state} FROM f WHERE idx = 0
  UNION ALL
  SELECT {keys}, idx, starts, CASE WHEN why IS NULL THEN e1 END, CASE WHEN why IS NULL THEN p1 END, CASE WHEN why IS NULL THEN s1 END, sign, goes, ready, fday, why, price, e1, p1, s1{told} FROM (
    SELECT {f_keys}, f.idx, f.sign,
      CASE WHEN {opens} THEN f.idx ELSE r.ei END AS e1, CASE WHEN {opens} THEN f.open ELSE r.ep END AS p1, CASE WHEN {opens} THEN r.nsg ELSE r.sg END AS s1, CASE WHEN {opens} THEN f.ts // 86400000 ELSE r.day END AS fday,
      p1 * (1 - s1 * ({stop}) / 100) AS sl, p1 * (1 + s1 * ({target}) / 100) AS tp, CASE WHEN s1 > 0 THEN f.low ELSE f.high END AS near, CASE WHEN s1 > 0 THEN f.high ELSE f.low END AS far,{more}
      CASE WHEN e1 IS NULL THEN NULL WHEN r.leave THEN 'Signal' WHEN s1 * f.open <= s1 * {before} THEN {by_open} WHEN s1 * f.open >= s1 * tp THEN 'TakeProfit' WHEN s1 * near <= s1 * {level} THEN {by_low} WHEN s1 * far >= s1 * tp THEN 'TakeProfit'{fin} WHEN f.idx = f.n - 1 THEN 'EndOfData' END AS why,
      CASE WHEN why = 'Signal' THEN f.open WHEN why IN ({stops}) THEN CASE WHEN s1 * f.open <= s1 * {before} THEN f.open ELSE {level} END WHEN why = 'TakeProfit' THEN CASE WHEN s1 * f.open >= s1 * tp THEN f.open ELSE tp END WHEN why IS NOT NULL THEN f.close END AS price,
      e1 IS NOT NULL AND why IS NULL AS held, held AND f.exit_ AND f.idx < f.n - 1 AS goes, {'CASE WHEN why IS NOT NULL THEN false ELSE r.armed END' if rearm else 'true'} AS able, NOT held AND able AND {free} AS starts, able OR (NOT held AND NOT f.entry{ok} AND f.idx < f.n - 1) AS ready
    FROM r JOIN f ON {on} AND f.idx = r.idx + 1)),
tx AS (
  SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY oi) - 1)::INTEGER AS trade_no, oi AS entry_idx, idx AS exit_idx, CASE WHEN og > 0 THEN 'long' ELSE 'short' END AS side, op AS entry_price, xp AS exit_price,
    100 * (og * (xp / op - 1) - {COST}::DOUBLE * (1 + xp / op)) AS return_pct, reason FROM r WHERE reason IS NOT NULL)
"""
