"""Queries of whole jobs over tables of strategies, and of series that are split by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import DAY, bars_per_year, step_ms
from barloom.operators import backtest, batches, clean, rules, stats, sweep, timesplit, verdicts
from barloom.operators.indicators import crosses
from barloom.sources import runs as store
from barloom.sources.adapters import bars_at, event_ticks
from barloom.sources.candle_store import merge_candles, stored_candles
from barloom.sources.paths import materialise, shared_path

from .base import BARS, SQL, query, trades_sql
from .data import NOW, W, bars, c1_sma, c2_ema, c3_rsi, c4_atr, c5_crosses
from .trading import CROSS, FRAME_GRADES, FRAMES, GRID, HOUR_YEAR, KEYS, NUMBERED, RUN, SERIES_KEYS, STEPS, TRADE_COLUMNS, TRADE_ROWS, TRIAL_EQUITY, TRIAL_FLAGS, _frames, _six, e5_backtest_trades

#: The buckets of the queries, so short that every series has many.
SPAN = 36 * 3_600_000
LATE_FROM = 1_705_500_000_000
MARKETS = ["CLICK", "ERROR", "NONE", "PURCHASE", "SIGNUP", "VIEW"]


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timesplit.numbered(bars(spark, sf_dir), span=F.lit(SPAN))


# -- a book of strategies -----------------------------------------------------------
def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy for each brand and size class of parts: levels follow the brand's number b, rules the class k."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("b"), (F.col("p_size") % 8).alias("k")).distinct()
    mean = F.concat(F.lit('{"ind":"sma","period":'), (F.col("b") % 4 * 4 + 3).cast("string"), F.lit("}"))
    level = (100 + F.col("b")).cast("string")
    one = lambda left, op, right: F.concat(F.lit(f'{{"left":{{"ind":"{left}"}},"op":"{op}","right":'), right, F.lit("}"))
    kind = F.col("k") % 4
    entry = (
        F.when(kind == 0, F.concat(F.lit('"all":['), one("close", "crosses_above", mean), F.lit("]")))
        .when(kind == 1, F.concat(F.lit('"all":['), one("close", "<", (110 + F.col("b")).cast("string")), F.lit('],"any":['), one("open", ">", level), F.lit(","), one("high", ">", (200 + 2 * F.col("b")).cast("string")), F.lit("]")))
        .when(kind == 2, F.concat(F.lit('"all":['), one("close", "crosses_below", mean), F.lit(","), one("open", ">", level), F.lit("]")))
        .otherwise(F.concat(F.lit('"any":['), one("close", ">", mean), F.lit(","), one("close", "<", level), F.lit("]")))
    )
    leave = F.when(F.col("k") < 4, F.concat(F.lit('"any":['), one("close", "crosses_below", F.lit('{"ind":"sma","period":10}')), F.lit("]"))).otherwise(F.concat(F.lit('"all":['), one("close", ">", (160 + F.col("b")).cast("string")), F.lit("]")))
    side = F.when((F.col("k") == 6) & (F.col("b") % 5 == 0), "up").when(F.col("k").isin(5, 7), "short").otherwise("long")
    stop = F.when(F.col("k") % 3 > 0, F.concat(F.lit(',"stop_loss_pct":'), (2 * F.col("k") + 2).cast("string"))).otherwise("")
    target = F.when(F.col("b") % 2 == 1, F.concat(F.lit(',"take_profit_pct":'), F.col("b").cast("string"))).otherwise("")
    claim = F.when(F.col("k") == 1, F.concat(F.lit(',"claim":{"win_rate_pct":'), (40 + F.col("b")).cast("string"), F.lit("}"))).otherwise("")
    text = F.concat(F.lit('{"asset":"VIEW","timeframe":"1h","side":"'), side, F.lit('","entry":{'), entry, F.lit('},"exit":{'), leave, F.lit("}"), stop, target, claim, F.lit("}"))
    return p.select(F.concat_ws("/", "b", "k").alias("strategy_id"), text.alias("json"))


#: The same strategies as columns, their flags on hourly bars, their trades, and the report of the runs on all markets asked for.
BOOK_FLAGS = f"""{NUMBERED}, book AS (SELECT *, b || '/' || k AS strategy_id, k = 6 AND b % 5 = 0 AS wrong FROM (SELECT DISTINCT replace(p_brand, 'Brand#', '')::INTEGER AS b, p_size % 8 AS k FROM part)),
s0 AS (SELECT *, {", ".join(f"CASE WHEN idx >= {n - 1} THEN avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS {n - 1} PRECEDING) END AS m{n}" for n in (3, 7, 10, 11, 15))} FROM bn),
s1 AS (SELECT *, lag(close) OVER w AS pc, {", ".join(f"lag(m{n}) OVER w AS p{n}" for n in (3, 7, 10, 11, 15))} FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
s2 AS (SELECT *, CASE b % 4 WHEN 0 THEN m3 WHEN 1 THEN m7 WHEN 2 THEN m11 ELSE m15 END AS m, CASE b % 4 WHEN 0 THEN p3 WHEN 1 THEN p7 WHEN 2 THEN p11 ELSE p15 END AS pm FROM s1, book WHERE NOT wrong),
f AS (
  SELECT strategy_id, symbol, idx, n, ts, open, high, low, close,
    coalesce(CASE k % 4 WHEN 0 THEN pc <= pm AND close > m WHEN 1 THEN close < 110 + b AND (open > 100 + b OR high > 200 + 2 * b) WHEN 2 THEN pc >= pm AND close < m AND open > 100 + b ELSE close > m OR close < 100 + b END, false) AS entry,
    coalesce(CASE WHEN k < 4 THEN pc >= p10 AND close < m10 ELSE close > 160 + b END, false) AS exit_, CASE WHEN k IN (5, 7) THEN -1 ELSE 1 END AS sign,
    CASE WHEN k % 3 > 0 THEN 2 * k + 2 END AS st, CASE WHEN b % 2 = 1 THEN b END AS tg FROM s2)"""
BOOK_REPORT = f"""WITH RECURSIVE {trades_sql(BOOK_FLAGS, keys="strategy_id, symbol", stop="f.st", target="f.tg")},
bf AS (SELECT *, product(1 + return_pct / 100) OVER (PARTITION BY strategy_id, symbol ORDER BY trade_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tx),
fg AS (SELECT strategy_id, symbol, count(*) AS made, count(*) FILTER (return_pct > 0) AS won, avg(return_pct) AS mean, bool_or(coalesce(before <= 0, false)) AS spent FROM bf GROUP BY ALL),
sz AS (SELECT symbol, count(*) AS bars FROM b GROUP BY symbol),
asked AS (SELECT strategy_id, book.b, k, wrong, symbol FROM book, (VALUES {", ".join(f"('{m}')" for m in MARKETS)}) AS v(symbol)),
rp AS (
  SELECT strategy_id, symbol, '1h' AS interval, CASE WHEN wrong THEN 'rejected' WHEN bars IS NULL THEN 'unchecked' WHEN spent THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN wrong THEN 'unknown side' WHEN bars IS NULL THEN 'no candles of ' || symbol || ' in 1h' WHEN spent THEN 'equity used up' END AS reason, bars,
    CASE WHEN status = 'ok' THEN coalesce(made, 0) END AS trades, CASE WHEN status = 'ok' THEN coalesce(won, 0) END AS wins, CASE WHEN status = 'ok' THEN coalesce(mean, 0) END AS expectancy_pct, CASE WHEN k = 1 THEN (40 + asked.b)::DOUBLE END AS claimed_win_rate
  FROM asked LEFT JOIN sz USING (symbol) LEFT JOIN fg USING (strategy_id, symbol))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, candles = _book(spark, sf_dir), materialise(bars(spark, sf_dir), "bars")
    conditions = rules.parse_conditions(texts)
    strategies = materialise(rules.validate_strategies(rules.parse_strategies(texts), conditions), "strategies")
    asked = strategies.select("strategy_id", F.explode(F.array(*map(F.lit, MARKETS))).alias("symbol"), F.lit("1h").alias("interval"))
    trades = batches.backtest_runs(candles, batches.programs(strategies, conditions), asked)
    return batches.with_claims(batches.run_report(asked, strategies, candles, trades), strategies)


@query(f"{BOOK_REPORT} SELECT * EXCLUDE (expectancy_pct), round(expectancy_pct, 6) AS expectancy_pct, 100 * wins / nullif(trades, 0) >= claimed_win_rate AS held FROM rp")
def job_strategy_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies that are rows of a table, each on all requested markets, one of which has no candles."""
    return _report(spark, sf_dir).drop("return_pct").withColumn("expectancy_pct", F.round("expectancy_pct", 6))


@query(f"{BOOK_REPORT} SELECT symbol, rank, strategy_id, trades, round(expectancy_pct, 6) AS expectancy_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(expectancy_pct, 9) DESC, strategy_id)::INTEGER AS rank FROM rp WHERE status = 'ok') WHERE rank <= 3")
def job_best_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strategies of the book that do best on each market."""
    return batches.best_runs(_report(spark, sf_dir), 3, "expectancy_pct").select("symbol", "rank", "strategy_id", "trades", F.round("expectancy_pct", 6).alias("expectancy_pct"))


#: The time at which the jobs' runs are saved, an argument as everywhere.
SAVED_AT = NOW


@query(f"{BOOK_REPORT} SELECT {SAVED_AT} AS created_at, symbol, count(*) AS runs, sum(trades)::BIGINT AS trades, round(sum(CASE WHEN trades > 0 THEN 100 * wins / trades ELSE 0 END), 4) AS win_rates FROM rp WHERE status = 'ok' GROUP BY symbol")
def job_saved_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's runs, saved in a store by id, listed, and added up by market."""
    texts, candles = _book(spark, sf_dir), materialise(bars(spark, sf_dir), "bars")
    path = shared_path(spark, "saved")
    store.save_by_id(batches.as_saved(materialise(_report(spark, sf_dir), "report"), texts, candles, SAVED_AT), path)
    listed = store.list_by_id(store.read_by_id(spark, path), 1_000_000)  # more than there can be runs of this book
    return listed.groupBy("created_at", "symbol").agg(F.count("*").alias("runs"), F.sum("trades").alias("trades"), F.round(F.sum("win_rate_pct"), 4).alias("win_rates"))


@query(
    RUN(
        TRIAL_FLAGS,
        TRIAL_EQUITY
        + """, w AS (SELECT f.symbol, f.trial_id, coalesce(avg(return_pct) FILTER (entry_idx >= floor(f.n * 0.7::DOUBLE)), 0) AS score FROM f LEFT JOIN tx ON tx.symbol = f.symbol AND tx.trial_id = f.trial_id WHERE f.idx = 0 GROUP BY ALL),
  k AS (SELECT symbol, trial_id, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, 'entry.all.0.right.period=' || p || '.0,stop_loss_pct=' || tg.s || ',take_profit_pct=' || tg.t)::INTEGER AS rank FROM w JOIN tg USING (trial_id))
  SELECT symbol, rank, trial_id, idx, round(equity, 6) AS equity FROM eq JOIN k USING (symbol, trial_id) WHERE rank <= 3""",
        keys="symbol, trial_id", stop="f.s", target="f.t",
    )
)
def job_best_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of the three best trials of a sweep on each series: figures of all trials first, then these again."""
    candles, combos = materialise(bars(spark, sf_dir), "bars"), sweep.grid_combos(spark, GRID)
    results = materialise(sweep.sweep_results(sweep.sweep_stats(candles, CROSS, combos, HOUR_YEAR, batch=9), combos, "expectancy"), "results")
    _, curves = batches.rerun_best(candles, CROSS, combos, results, 3)
    return curves.select("symbol", "rank", "trial_id", "idx", F.round("equity", 6).alias("equity"))


@query(
    W(
        f""", v AS (SELECT symbol, interval, ts, close, idx, ts // 86400000 AS day, ts >= {LATE_FROM} AS late FROM b)
  SELECT symbol, interval, ts, CASE WHEN idx % 3 = 1 THEN close + 1 ELSE close END AS close, CASE WHEN day IN (SELECT ts // 86400000 FROM v AS o WHERE o.late AND o.symbol = v.symbol) THEN 2 ELSE 1 END AS version FROM v WHERE idx % 3 <> 1 OR late"""
    )
)
def a3_late_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of two thirds of the bars, then one of all late bars with other prices: what came first stays, and days without late rows are not written again."""
    rows = _numbered(spark, sf_dir).withColumn("arrival", F.col("idx"))
    path = shared_path(spark, "store")
    merge_candles(rows.where("idx % 3 <> 1"), path)
    merge_candles(rows.where(F.col("ts") >= LATE_FROM).withColumn("close", F.col("close") + 1), path)
    return stored_candles(spark, path).select("symbol", "interval", "ts", "close", "version")


VOTED = f"""WITH RECURSIVE {trades_sql(FRAMES, keys=SERIES_KEYS, stop="4", target="8")} {FRAME_GRADES},
  asked AS (SELECT symbol, interval FROM (VALUES {", ".join(f"('{m}')" for m in MARKETS)}) AS m(symbol), (VALUES {", ".join(f"('{i}')" for i in STEPS)}) AS i(interval)),
  rq AS (SELECT asked.*, grade FROM asked LEFT JOIN gr USING (symbol, interval)),
  k AS (SELECT interval, count(grade) AS tested, count(*) AS requested, count(*) FILTER (grade = 'holds') AS holds, {", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g}, string_agg(symbol, ', ' ORDER BY symbol) FILTER (grade = '{g}') AS in_{g}" for g in ("fails", "fragile", "not_enough_data"))}, string_agg(symbol, ', ' ORDER BY symbol) FILTER (grade IS NULL) AS missing FROM rq GROUP BY interval)"""


@query(
    f"""{VOTED} SELECT interval, CASE WHEN tested < 2 THEN 'not_enough_data' WHEN n_fails > 0 THEN 'fails' WHEN requested > tested OR n_fragile > 0 THEN 'fragile' WHEN n_not_enough_data > 0 THEN CASE WHEN holds = 0 THEN 'not_enough_data' ELSE 'fragile' END ELSE 'holds' END AS grade, holds, tested, requested, missing AS unchecked,
  concat_ws(' ', CASE WHEN tested < 2 THEN 'Markets checked: ' || tested || '; at least two are needed.' END, 'Fails on ' || in_fails || '.', 'Could not be checked: ' || missing || '.', 'Fragile on ' || in_fragile || '.', 'Too few trades on ' || in_not_enough_data || '.', CASE WHEN holds > 0 THEN 'Holds on ' || holds || ' of ' || requested || ' markets.' END) AS reasons FROM k"""
)
def job_requested_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote on one strategy over all requested markets in each timeframe, with its reasons; one market has no candles."""
    listed = lambda values: F.explode(F.array(*map(F.lit, values)))
    asked = spark.range(1).select(listed(MARKETS).alias("symbol")).select("symbol", listed(list(STEPS)).alias("interval"))
    graded = verdicts.requested(asked, _frames(spark, sf_dir).select("symbol", "interval", "grade"), ["symbol", "interval"])
    vote = verdicts.cross_market(graded, ["interval"])
    return vote.withColumns({"reasons": F.array_join("reasons", " "), "unchecked": F.array_join("unchecked", ", ")})


@query(
    f"""WITH RECURSIVE {trades_sql(FRAMES, keys=SERIES_KEYS, stop="4", target="8")} {FRAME_GRADES},
  sd AS (SELECT symbol, interval, stddev_pop(return_pct) AS sd FROM ru JOIN tx USING ({SERIES_KEYS}) WHERE entry_idx >= cut GROUP BY ALL),
  h AS (SELECT gr.symbol, gr.interval, gr.grade, coalesce(o.trades, 0) AS n, coalesce(o.expectancy_pct, 0) AS e, coalesce(o.trades >= 10 AND abs(o.expectancy_pct) < sd / sqrt(o.trades), false) AS softened FROM gr LEFT JOIN o USING ({SERIES_KEYS}) LEFT JOIN sd USING ({SERIES_KEYS}))
  SELECT symbol, interval, grade, softened, CASE WHEN grade = 'not_enough_data' THEN printf('{verdicts.NEEDS}', n) WHEN grade = 'holds' THEN '{verdicts.HELD}' WHEN softened THEN printf('{verdicts.QUIET}', CASE WHEN e > 0 THEN 'gain' ELSE 'loss' END) WHEN grade = 'fails' THEN '{verdicts.LOST}' ELSE '{verdicts.WEAK}' END AS headline FROM h"""
)
def g2_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade and headline of one strategy on every market in four timeframes."""
    b = materialise(clean.fit_range(bars_at(event_ticks(spark, sf_dir), STEPS), NOW), "bars")
    t = materialise(backtest.run_strategy(b, CROSS), "trades")
    split = _six(stats.split_stats(t, backtest.equity_curve(b, t), KEYS, 0.7, bars_per_year(F.col("interval"))), TRADE_COLUMNS)
    return verdicts.verdicts(split, KEYS).select("symbol", "interval", "grade", "softened", "headline")


class OneFillADay(backtest.Strategy):
    """Wide rising bars, until there was a fill on their day."""

    def __init__(self) -> None:
        self.day: int | None = None

    def signals(self, bars, start):  # noqa: ANN001, ANN201
        wide = (bars["high"] - bars["low"] > 8).to_numpy()
        rises = (bars["close"] > bars["open"]).to_numpy()
        return wide & rises & (bars["ts"] // DAY != self.day).to_numpy(), ~wide, "long"

    def filled(self, bars, at, side) -> None:  # noqa: ANN001
        self.day = bars["ts"].iloc[at] // DAY


@query(RUN("f AS (SELECT *, high - low > 8 AND close > open AS entry, NOT (high - low > 8) AS exit_, 1 AS sign FROM bn)", TRADE_ROWS, stop="6", rearm=False, once_a_day=True))
def d5_stateful_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's strategy that keeps a state and hears of its fills."""
    found = backtest.stateful_trades(bars(spark, sf_dir), OneFillADay, rearm=False, stop_pct=6.0)
    return found.withColumns({c: F.round(c, 6) for c in ("entry_price", "exit_price", "return_pct")})


# -- parameters of sweeps --------------------------------------------------------------
@query(
    """WITH s AS (SELECT p_partkey, p_partkey % 2 = 0 AS whole, p_size / 4.0::DOUBLE AS lo, p_size / 4.0::DOUBLE + p_partkey % 13 - 1 AS hi, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 5) * 0.25::DOUBLE END AS step FROM part),
  v AS (SELECT p_partkey, lo > hi AS turned, NOT whole AND step IS NULL AS stepless, CASE WHEN whole THEN ceil(lo) ELSE lo END AS a, CASE WHEN whole THEN floor(hi) ELSE hi END AS z, CASE WHEN whole THEN greatest(1, floor(coalesce(step, 1) + 0.5)) ELSE step END AS d FROM s),
  w AS (SELECT *, CASE WHEN turned OR stepless OR a > z THEN [] ELSE [least(a + i * d, z) FOR i IN range(0, floor((z + 1e-9 - a) / d)::BIGINT + 1)] END AS xs FROM v),
  x AS (SELECT *, CASE WHEN len(xs) > 0 AND z - xs[-1] > 1e-12 THEN list_append(xs, z) ELSE xs END AS ys FROM w)
  SELECT p_partkey, CASE WHEN turned THEN 'a range needs finite min and max, min first' WHEN stepless THEN 'a float range needs a step above 0' WHEN len(ys) = 0 THEN '1 to 512 values' END AS error,
    CASE WHEN len(ys) > 0 THEN len(ys) END AS n, round(ys[1], 6) AS first, round(ys[-1], 6) AS last, round(list_sum(ys), 6) AS total FROM x"""
)
def h1_expand_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a range of parameters for each part, whole numbers for every second one."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    low = F.col("p_size") / 4
    specs = p.select("p_partkey", F.when(k % 2 == 0, "int").otherwise("float").alias("kind"), F.lit(None).cast("array<double>").alias("values"), low.alias("min"), (low + k % 13 - 1).alias("max"), F.when(k % 5 > 0, k % 5 * 0.25).alias("step"))
    found = sweep.expand_specs(specs)
    v = F.col("expanded")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return found.select("p_partkey", "error", F.when(v.isNotNull(), F.size(v)).cast("long").alias("n"), F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"), F.round(total, 6).alias("total"))


# -- series split by time -------------------------------------------------------------
def _sql(of: Callable) -> str:
    return SQL[of.__name__]


def _recurrence(spark: SparkSession, sf_dir: str, kind: str, n: int) -> DataFrame:
    name = f"{kind}_{n}"
    return timesplit.split_recurrences(bars(spark, sf_dir), [(kind, n)], F.lit(SPAN)).select("symbol", "ts", F.round(name, 6).alias(name))


@query(_sql(c2_ema))
def c2_split_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA with each series spread over its buckets."""
    return _recurrence(spark, sf_dir, "ema", 20)


@query(_sql(c3_rsi))
def c3_split_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI with each series spread over its buckets."""
    return _recurrence(spark, sf_dir, "rsi", 14)


@query(_sql(c4_atr))
def c4_split_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATR with each series spread over its buckets."""
    return _recurrence(spark, sf_dir, "atr", 14)


@query(_sql(c1_sma))
def c1_split_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving average over blocks that borrow the bars before them."""
    mean = lambda w: F.when(F.col("idx") >= 9, F.avg("close").over(w.rowsBetween(-9, 0)))
    return timesplit.windowed(_numbered(spark, sf_dir), 9, {"m": mean}, size=32).select("symbol", "ts", F.round("m", 6).alias("sma_10"))


@query(_sql(c5_crosses))
def c5_split_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosses of a moving average over blocks that borrow the bars before them."""
    mean = lambda w: F.round(F.when(F.col("idx") >= 9, F.avg("close").over(w.rowsBetween(-9, 0))), 9)
    rows = timesplit.windowed(_numbered(spark, sf_dir), 9, {"m": mean}, size=32)
    crossed = {n: (lambda w, up=up: crosses(F.col("close"), F.col("m"), up, w)) for up, n in ((True, "above"), (False, "below"))}
    return timesplit.windowed(rows, 1, crossed, size=32).select("symbol", "ts", "above", "below")


@query(
    W(
        """, d AS (SELECT symbol, interval, ts, idx, CASE WHEN idx % 50 = 7 THEN low - 1 ELSE high END AS high, low, open, close FROM b)
  SELECT symbol, interval, ts, idx, lag(ts) OVER w AS prev_ts, coalesce(ts - lag(ts) OVER w > 3600000, false) AS gap, CASE WHEN high < low THEN 'high is below low' END AS reason FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
    )
)
def b6_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of bars and gaps before them, with the bar before an edge taken from the bucket before."""
    rows = timesplit.with_previous(_numbered(spark, sf_dir), {"ts": "prev_ts"})
    bad = rows.withColumn("high", F.when(F.col("idx") % 50 == 7, F.col("low") - 1).otherwise(F.col("high")))
    gap = F.coalesce(F.col("ts") - F.col("prev_ts") > step_ms(F.col("interval")), F.lit(False))
    return bad.select("symbol", "interval", "ts", "idx", "prev_ts", gap.alias("gap"), clean.candle_fault(F.col("prev_ts")).alias("reason"))


@query(_sql(e5_backtest_trades))
def e5_split_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and trades of one strategy, with each series spread over its buckets from end to end."""
    flagged = timesplit.split_rules(bars(spark, sf_dir), CROSS, F.lit(SPAN), size=32)
    found = timesplit.split_trades(flagged, stop_pct=4.0, target_pct=8.0, span=F.lit(SPAN))
    return found.withColumns({c: F.round(c, 6) for c in ("entry_price", "exit_price", "return_pct")})


@query(
    f"""WITH {BARS.strip()}, o AS (SELECT symbol, idx, idx + 1 AS at, CASE WHEN idx % 4 < 2 THEN 'buy' ELSE 'sell' END AS side, close * (CASE WHEN idx % 4 IN (0, 3) THEN 1 + (idx % 7) * 0.05::DOUBLE ELSE 1 - (idx % 7) * 0.03::DOUBLE END) AS price, idx % 4 IN (1, 3) AS lim FROM b WHERE idx % 3 = 0),
  k AS (SELECT o.symbol, o.idx, o.at, o.side, o.price, o.lim, b.idx AS x, b.open AS bo, CASE WHEN (side = 'buy') = lim THEN b.open <= o.price ELSE b.open >= o.price END AS gap, CASE WHEN (side = 'buy') = lim THEN b.low <= o.price ELSE b.high >= o.price END AS hit FROM o JOIN b ON b.symbol = o.symbol AND b.idx >= o.at),
  h AS (SELECT symbol, idx, min(x) AS fill_idx, min_by(CASE WHEN gap THEN bo ELSE price END, x) AS fill_price FROM k WHERE gap OR hit GROUP BY symbol, idx)
  SELECT o.symbol, o.idx, CASE WHEN lim THEN 'limit' ELSE 'stop' END AS kind, side, round(price, 6) AS price, h.fill_idx, round(h.fill_price, 6) AS fill_price FROM o LEFT JOIN h ON h.symbol = o.symbol AND h.idx = o.idx"""
)
def e1_resting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where limit and stop orders that rest from a bar on are filled, however late."""
    rows = materialise(timesplit.numbered(bars(spark, sf_dir), span=F.lit(SPAN)), "bars")
    four = F.col("idx") % 4
    price = F.col("close") * F.when(four.isin(0, 3), 1 + F.col("idx") % 7 * 0.05).otherwise(1 - F.col("idx") % 7 * 0.03)
    orders = rows.where("idx % 3 = 0").select("symbol", "interval", "idx", (F.col("idx") + 1).alias("from_idx"), F.when(four < 2, "buy").otherwise("sell").alias("side"), F.when(four.isin(1, 3), "limit").otherwise("stop").alias("kind"), price.alias("price"))
    found = timesplit.resting_fills(orders, rows)
    return found.select("symbol", "idx", "kind", "side", F.round("price", 6).alias("price"), "fill_idx", F.round("fill_price", 6).alias("fill_price"))
