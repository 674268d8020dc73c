"""Queries of sources, cleaning and indicators (inventory A, B and C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import columns as col
from barloom.operators import clean, indicators
from barloom.sources import candles as io
from barloom.sources import runs as store
from barloom.sources.adapters import candles_from_events, candles_from_lineitem
from barloom.sources.paths import shared_path

from .base import BARS, query

NOW = 1_706_000_000_000  # the time of asking: an argument, never the clock
OHLC = ["open", "high", "low", "close"]


def W(body: str) -> str:
    return f"WITH {BARS.strip()} {body}"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_events(spark, sf_dir)


@query(W("SELECT symbol, interval, ts, open, high, low, close FROM c"))
def a0_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)


@query(
    """SELECT 'S' || l_suppkey AS symbol, '1d' AS interval, epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % 86400000 AS ts,
    round(first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey * 16 + l_linenumber), 9) AS open, round(max(l_extendedprice / l_quantity), 9) AS high,
    round(min(l_extendedprice / l_quantity), 9) AS low, round(last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey * 16 + l_linenumber), 9) AS close FROM lineitem GROUP BY ALL"""
)
def a0_daily_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_lineitem(spark, sf_dir).select("symbol", "interval", "ts", *(F.round(c, 9).alias(c) for c in OHLC))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array(F.col("ts").cast("string"), *(F.col(c).cast("string") for c in OHLC), F.lit("0"))
    return bars(spark, sf_dir).groupBy("symbol", "interval", col.day_id(F.col("ts")).alias("day")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ts", row.alias("r")))), lambda x: x["r"])).alias("payload")).drop("day")


@query(W("SELECT symbol, interval, ts, open, high, low, close FROM c"))
def a1_read_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_klines(_payloads(spark, sf_dir)).drop("row")


@query(W("SELECT symbol, interval, ts, open, high, low, close FROM c"))
def a2_read_candles_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    io.write_candles(bars(spark, sf_dir), path, "csv")
    return io.read_candles_csv(spark, path)


@query(W("SELECT symbol, interval, count(*) AS n, round(sum(close), 4) AS closes FROM c GROUP BY ALL"))
def a3_write_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "candles")
    df = bars(spark, sf_dir)
    io.write_candles(df, path)
    io.write_candles(df.where("symbol = 'CLICK'"), path)  # replaces this series only
    return spark.read.parquet(path).groupBy("symbol", "interval").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("closes"))


START, END = 1_704_500_123_456, 1_706_500_000_000


@query(W(f"SELECT symbol, interval, ts, close FROM c WHERE ts >= {START} - {START} % 3600000 AND ts <= least({END}, {NOW} - {NOW} % 3600000 - 3600000)"))
def a4_load_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.load_range(bars(spark, sf_dir), START, END, NOW, 3_600_000).select("symbol", "interval", "ts", "close")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each series and day, whose stats are of the day's bars."""
    day = col.day_id(F.col("ts"))
    g = bars(spark, sf_dir).groupBy("symbol", "interval", day.alias("day")).agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), F.count("*").alias("trades"), F.round(F.max("high"), 6).alias("sharpe"))
    stats = F.when(F.col("day") % 7 == 0, F.struct(F.col("trades"), F.lit(None).cast("double").alias("sharpe"))).otherwise(F.struct("trades", "sharpe"))
    empty = F.array().cast("array<double>")
    return g.select((F.col("day") * col.DAY).alias("created_at"), "symbol", "interval", "start_ms", "end_ms", F.struct(F.lit("long").alias("side")).alias("strategy"), stats.alias("stats"), F.struct(F.lit(0).alias("x")).alias("metrics"), empty.alias("equity_curve"), empty.alias("trades"))


RUNS = "r AS (SELECT symbol, interval, ts // 86400000 AS day, min(ts) AS start_ms, max(ts) AS end_ms, count(*) AS trades, round(max(high), 6) AS sharpe FROM c GROUP BY ALL)"


@query(W(f", {RUNS} SELECT day * 86400000 AS created_at, symbol, start_ms, end_ms, trades, CASE WHEN day % 7 = 0 THEN NULL ELSE sharpe END AS sharpe, 'local' AS owner_id FROM r"))
def a5_save_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "runs")
    runs = _runs(spark, sf_dir)
    store.save_runs(runs.where("symbol < 'F'"), path)
    store.save_runs(runs.where("symbol >= 'F'"), path)
    s = F.from_json("stats", "trades long, sharpe double")
    return store.read_runs(spark, path).select("created_at", "symbol", "start_ms", "end_ms", s["trades"].alias("trades"), s["sharpe"].alias("sharpe"), "owner_id")


@query(W(f", {RUNS} SELECT day * 86400000 AS created_at, count(*) AS n, sum(trades)::BIGINT AS trades, sum(CASE WHEN day % 7 = 0 THEN 0 ELSE sharpe END) AS sharpe, 0.0::DOUBLE AS drawdown FROM r WHERE day >= (SELECT max(day) - 9 FROM r) GROUP BY day"))
def a6_list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs, added up by day; the limit is a multiple of the runs of a day where every series has each day."""
    rows = store.run_rows(_runs(spark, sf_dir))
    newest = rows.agg(F.max("created_at")).first()[0]
    listed = store.list_runs(rows.where(F.col("created_at") >= newest - 9 * col.DAY), 10_000)
    return listed.groupBy("created_at").agg(F.count("*").alias("n"), F.sum("trades").alias("trades"), F.sum("sharpe").alias("sharpe"), F.sum("max_drawdown_pct").alias("drawdown"))


@query(W(f", {RUNS} SELECT symbol, start_ms, trades FROM r WHERE symbol = 'CLICK' AND day = (SELECT max(day) FROM r WHERE symbol = 'CLICK')"))
def a7_get_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.run_rows(_runs(spark, sf_dir))
    wanted = rows.where("symbol = 'CLICK'").agg(F.max_by("id", "created_at")).first()[0]
    return store.get_run(rows, wanted).select("symbol", "start_ms", F.col("stats.trades").alias("trades"))


@query(W(f", {RUNS} SELECT CASE WHEN symbol = 'CLICK' THEN 'me' ELSE 'local' END AS owner_id, count(*) AS n FROM r GROUP BY ALL"))
def a8_upgrade_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.run_rows(_runs(spark, sf_dir))
    old = rows.where("symbol <> 'CLICK'").drop("owner_id")
    new = rows.where("symbol = 'CLICK'").withColumn("owner_id", F.lit("me"))
    return store.upgrade_runs(store.upgrade_runs(old.unionByName(new, allowMissingColumns=True))).groupBy("owner_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, coalesce(regexp_full_match(s, '[A-Z0-9]{2,20}'), false) AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '')) ELSE p_brand END AS s FROM part)")
def b1_valid_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).otherwise(F.col("p_brand"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", col.valid_symbol(text).alias("valid"))


INTERVAL_OF = "CASE event_id % 7 WHEN 0 THEN '1m' WHEN 1 THEN '5m' WHEN 2 THEN '15m' WHEN 3 THEN '1h' WHEN 4 THEN '4h' WHEN 5 THEN '1d' ELSE '2w' END"
STEP_OF = "CASE event_id % 7 WHEN 0 THEN 60000 WHEN 1 THEN 300000 WHEN 2 THEN 900000 WHEN 3 THEN 3600000 WHEN 4 THEN 14400000 WHEN 5 THEN 86400000 END::BIGINT"


@query(f"SELECT {INTERVAL_OF} AS interval, {STEP_OF} AS step_ms, CASE event_id % 7 WHEN 0 THEN 525600 WHEN 1 THEN 105120 WHEN 2 THEN 35040 WHEN 3 THEN 8760 WHEN 4 THEN 2190 WHEN 5 THEN 365 END::BIGINT AS bars_per_year, count(*) AS n FROM events GROUP BY ALL")
def b2_interval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(INTERVAL_OF).alias("interval"))
    return col.interval_table(e).groupBy("interval", "step_ms", "bars_per_year").agg(F.count("*").alias("n"))


@query("SELECT event_id, (epoch_ms(ts) - 1705000000000) - ((epoch_ms(ts) - 1705000000000) % 900000 + 900000) % 900000 AS start FROM events")
def b3_align_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.adapters import millis

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", col.align_start(millis(e, "ts") - 1_705_000_000_000, F.lit(900_000)).alias("start"))


@query(W(f"SELECT symbol, interval, ts, close FROM c WHERE ts BETWEEN {START} AND {NOW}"))
def b4_normalise_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("arrival", F.lit(1))
    late = b.withColumns({"close": F.col("close") + 1, "arrival": F.lit(2)})
    return clean.normalise_candles(late.unionByName(b), START, NOW).select("symbol", "interval", "ts", "close")


@query(W(f"SELECT symbol, interval, ts FROM c WHERE ts + 3600000 <= {NOW}"))
def b5_drop_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_unclosed(bars(spark, sf_dir), NOW, col.step_ms(F.col("interval"))).select("symbol", "interval", "ts")


@query(
    W(
        """, d AS (SELECT symbol, interval, ts, idx, CASE WHEN idx % 50 = 7 THEN low - 1 ELSE high END AS high, CASE WHEN idx % 50 = 9 THEN close + 1 ELSE low END AS low, open, CASE WHEN idx % 50 = 11 THEN NULL ELSE close END AS close FROM b)
  SELECT symbol, interval, ts, idx, CASE WHEN close IS NULL THEN 'close is not finite' WHEN high < low THEN 'high is below low' WHEN high < greatest(open, close) THEN 'high is below open or close' WHEN low > least(open, close) THEN 'low is above open or close' END AS reason FROM d"""
    )
)
def b6_validate_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = indicators.with_idx(bars(spark, sf_dir))
    k = F.col("idx") % 50
    bad = b.withColumns({"high": F.when(k == 7, F.col("low") - 1).otherwise(F.col("high")), "low": F.when(k == 9, F.col("close") + 1).otherwise(F.col("low")), "close": F.when(k != 11, F.col("close"))})
    return clean.validate_candles(bad).select("symbol", "interval", "ts", "idx", "reason")


@query(W("SELECT symbol, interval, prev_ts, ts FROM (SELECT symbol, interval, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts, ts FROM c) WHERE ts - prev_ts > 3600000"))
def b7_find_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.find_gaps(bars(spark, sf_dir))


@query(f"SELECT event_id, (event_id * 9973000 // {STEP_OF} + 1)::BIGINT AS bars, event_id * 9973000 // {STEP_OF} + 1 <= 100000 AS within_cap FROM events WHERE event_id % 7 < 6")
def b8_range_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 7 < 6")
    return clean.range_limit(e.select("event_id", F.expr(INTERVAL_OF).alias("interval"), F.lit(0).cast("long").alias("start_ms"), (F.col("event_id") * 9_973_000).alias("end_ms"))).select("event_id", "bars", "within_cap")


@query(W(f", w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM c WHERE ts BETWEEN {NOW} - 199 * 3600000 AND {NOW}) SELECT symbol, ts FROM w WHERE n <= 150"))
def b9_fit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.latest_bars(clean.fit_range(bars(spark, sf_dir), NOW, 200), 150).select("symbol", "ts")


@query(W("SELECT symbol, ts, ((ts % 86400000) // 60000)::INTEGER AS minute, ts % 86400000 >= 34200000 AND ts % 86400000 < 57600000 AS day_session, ts % 86400000 >= 79200000 OR ts % 86400000 < 21600000 AS night_session FROM c"))
def b10_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return bars(spark, sf_dir).select("symbol", "ts", col.minute_of_day(t).alias("minute"), col.in_session(t, 570, 960).alias("day_session"), col.in_session(t, 1320, 360).alias("night_session"))


@query(W("SELECT symbol, ts, ts // 86400000 AS day_id, coalesce(lag(ts // 86400000) OVER (PARTITION BY symbol ORDER BY ts) <> ts // 86400000, true) AS is_new_day FROM c"))
def b11_day_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.mark_days(bars(spark, sf_dir)).select("symbol", "ts", "day_id", "is_new_day")


@query(
    f"""SELECT event_id, coalesce(fee, 5.0) AS fee_bps, CASE WHEN step IS NULL THEN 'unknown interval' WHEN s >= e THEN 'start must be before end' WHEN (e - s) // step + 1 > 100000 THEN 'too many bars'
  WHEN coalesce(fee, 5.0) > 1000 THEN 'bad fee' WHEN split <= 0 OR split >= 1 THEN 'bad split' END AS error
  FROM (SELECT event_id, {STEP_OF} AS step, event_id * 7 AS s, event_id * event_id * 37 AS e, CASE WHEN event_id % 3 = 0 THEN value * 20 END AS fee, CASE WHEN event_id % 2 = 0 THEN value / 40 END AS split FROM events)"""
)
def b12_validate_run_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.expr(INTERVAL_OF).alias("interval"), (i * 7).alias("start_ms"), (i * i * 37).alias("end_ms"), F.when(i % 3 == 0, F.col("value") * 20).alias("fee_bps"), F.lit(None).cast("double").alias("slippage_bps"), F.when(i % 2 == 0, F.col("value") / 40).alias("split")
    )
    return clean.validate_run_params(e).select("event_id", "fee_bps", "error")


@query(W("SELECT symbol, ts, CASE WHEN idx >= 9 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), 6) END AS sma_10 FROM b"))
def c1_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "ts", F.round(indicators.sma(F.col("close"), 10, Window.partitionBy("symbol", "interval").orderBy("ts")), 6).alias("sma_10"))


@query(
    "WITH RECURSIVE "
    + BARS.strip()
    + """, s AS (SELECT symbol, avg(close) AS seed FROM b WHERE idx < 20 GROUP BY symbol),
  e AS (SELECT b.symbol, b.idx, b.ts, s.seed AS v FROM b JOIN s USING (symbol) WHERE idx = 19
        UNION ALL SELECT b.symbol, b.idx, b.ts, b.close * (2.0::DOUBLE / 21) + e.v * (1 - 2.0::DOUBLE / 21) FROM e JOIN b ON b.symbol = e.symbol AND b.idx = e.idx + 1)
  SELECT b.symbol, b.ts, round(e.v, 6) AS ema_20 FROM b LEFT JOIN e ON b.symbol = e.symbol AND b.idx = e.idx"""
)
def c2_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.with_recurrences(bars(spark, sf_dir), [("ema", 20)]).select("symbol", "ts", F.round("ema_20", 6).alias("ema_20"))


@query(
    "WITH RECURSIVE "
    + BARS.strip()
    + """, m AS (SELECT symbol, idx, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS d FROM b),
  g AS (SELECT symbol, idx, ts, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM m WHERE d IS NOT NULL),
  s AS (SELECT symbol, avg(up) AS u, avg(dn) AS n FROM g WHERE idx <= 14 GROUP BY symbol),
  r AS (SELECT g.symbol, g.idx, s.u, s.n FROM g JOIN s USING (symbol) WHERE g.idx = 14
        UNION ALL SELECT g.symbol, g.idx, (r.u * 13 + g.up) / 14, (r.n * 13 + g.dn) / 14 FROM r JOIN g ON g.symbol = r.symbol AND g.idx = r.idx + 1)
  SELECT b.symbol, b.ts, round(CASE WHEN r.n = 0 THEN CASE WHEN r.u = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + r.u / r.n) END, 6) AS rsi_14 FROM b LEFT JOIN r ON b.symbol = r.symbol AND b.idx = r.idx"""
)
def c3_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.with_recurrences(bars(spark, sf_dir), [("rsi", 14)]).select("symbol", "ts", F.round("rsi_14", 6).alias("rsi_14"))


TR = "tr AS (SELECT symbol, idx, ts, CASE WHEN idx = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS v FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx))"


@query(W(f", {TR} SELECT symbol, ts, round(v, 6) AS true_range FROM tr"))
def c4_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "ts", F.round(indicators.true_range(), 6).alias("true_range"))


@query(
    "WITH RECURSIVE "
    + BARS.strip()
    + f""", {TR}, s AS (SELECT symbol, avg(v) AS seed FROM tr WHERE idx < 14 GROUP BY symbol),
  a AS (SELECT tr.symbol, tr.idx, s.seed AS x FROM tr JOIN s USING (symbol) WHERE idx = 13 UNION ALL SELECT tr.symbol, tr.idx, (a.x * 13 + tr.v) / 14 FROM a JOIN tr ON tr.symbol = a.symbol AND tr.idx = a.idx + 1)
  SELECT b.symbol, b.ts, round(a.x, 6) AS atr_14 FROM b LEFT JOIN a ON b.symbol = a.symbol AND b.idx = a.idx"""
)
def c4_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.with_recurrences(bars(spark, sf_dir), [("atr", 14)]).select("symbol", "ts", F.round("atr_14", 6).alias("atr_14"))


@query(
    W(
        """, s AS (SELECT *, CASE WHEN idx >= 9 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), 9) END AS m FROM b)
  SELECT symbol, ts, coalesce(lag(close) OVER w <= lag(m) OVER w AND close > m, false) AS above, coalesce(lag(close) OVER w >= lag(m) OVER w AND close < m, false) AS below FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
    )
)
def c5_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("m", F.round(indicators.sma(F.col("close"), 10), 9))
    return b.select("symbol", "ts", *(indicators.crosses(F.col("close"), F.col("m"), up).alias(n) for up, n in ((True, "above"), (False, "below"))))


@query(
    W(
        """, d AS (SELECT *, ts // 86400000 AS day, row_number() OVER (PARTITION BY symbol, ts // 86400000 ORDER BY ts) AS n FROM c),
  r AS (SELECT *, max(CASE WHEN n <= 4 THEN high END) OVER w AS rh, min(CASE WHEN n <= 4 THEN low END) OVER w AS rl FROM d WINDOW w AS (PARTITION BY symbol, day))
  SELECT symbol, ts, round(rh, 6) AS range_high, round(rl, 6) AS range_low, CASE WHEN n > 4 AND close > rh * 1.001::DOUBLE THEN 'long' WHEN n > 4 AND close < rl * 0.999::DOUBLE THEN 'short' END AS side FROM r"""
    )
)
def c6_opening_range_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.opening_range_breakout(bars(spark, sf_dir), 4, 0.1).select("symbol", "ts", F.round("range_high", 6).alias("range_high"), F.round("range_low", 6).alias("range_low"), "side")
