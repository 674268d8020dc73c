"""Reading and writing candles: raw kline payloads, CSV, partitioned Parquet, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import align_start
from barloom.operators.clean import drop_unclosed, normalise_candles

FIELDS = ["openTime", "open", "high", "low", "close"]
CSV_SCHEMA = "ts long, open double, high double, low double, close double"


def read_klines(payloads: DataFrame, payload: str = "payload", mode: str = "fail") -> DataFrame:
    """Candles of JSON arrays of arrays, keyed by the other columns of ``payloads``; numbers may be strings.

    mode 'fail' raises at the first bad row, with its number and field;
    'quarantine' returns every row with ``error`` (NULL where the row is good).
    """
    keys = [c for c in payloads.columns if c != payload]
    rows = payloads.select(*keys, F.posexplode_outer(F.from_json(payload, "array<array<string>>")).alias("row", "v"))
    value = [F.get("v", F.lit(i)) for i in range(5)]
    parsed = [value[0].try_cast("long"), *(v.try_cast("double") for v in value[1:])]
    bad = F.coalesce(
        F.when(F.col("v").isNull(), F.lit("payload is no array of arrays")),
        F.when(F.size("v") < 5, F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(": fewer than 5 fields"))),
        *(F.when(p.isNull(), F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(f": bad {name}"))) for p, name in zip(parsed, FIELDS, strict=True)),
    )
    out = rows.select(*keys, "row", *(p.alias(n) for p, n in zip(parsed, ["ts", *FIELDS[1:]], strict=True)), bad.alias("error"))
    if mode == "quarantine":
        return out
    return out.withColumn("ts", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("long")).otherwise(F.col("ts"))).drop("error")


def read_candles_csv(spark: SparkSession, path: str, symbol: Column | None = None, interval: Column | None = None) -> DataFrame:
    """Candles of CSV files with a header and exactly five fields, sorted and deduplicated; keys from partition folders unless given."""
    df = spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    if symbol is not None:
        df = df.withColumn("symbol", symbol)
    if interval is not None:
        df = df.withColumn("interval", interval)
    df = df.withColumn("arrival", F.monotonically_increasing_id())
    return normalise_candles(df, order="arrival").select("symbol", "interval", "ts", "open", "high", "low", "close")


def write_candles(candles: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each symbol and interval; what is written replaces these folders only."""
    writer = candles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "interval")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def load_range(candles: DataFrame, start: int, end: int, now: int, step: int) -> DataFrame:
    """Closed bars from start, aligned down to the step, to the end; none if start is after end."""
    first = align_start(F.lit(start), F.lit(step))
    last = F.least(F.lit(end), align_start(F.lit(now), F.lit(step)) - step)
    return drop_unclosed(candles.where((F.col("ts") >= first) & (F.col("ts") <= last)), now, F.lit(step))
