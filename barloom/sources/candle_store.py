"""A store of candles that takes late rows: versions of days, and a log of what is committed.

``data`` has a folder for each version, series and day; ``commits`` tells which
version of a day is the last one. A load writes a new version of the days that it
touches and commits them in one file at the end. Readers go by the commits, so
they see each load wholly or not at all, and a load that fails leaves files that
no one reads. One load runs at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import day_id
from barloom.operators.clean import SERIES
from barloom.sources.paths import materialise

BAR = "ts long, open double, high double, low double, close double"
DAY = [*SERIES, "day"]
DATA = f"{BAR}, version long, symbol string, interval string, day long"
COMMIT = "symbol string, interval string, day long, version long"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, interval, day, version): the last version of each day; no rows before the first load."""
    try:
        found = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMIT)
    return found.groupBy(*DAY).agg(F.max("version").alias("version"))


def stored_candles(spark: SparkSession, path: str) -> DataFrame:
    """The candles of the store, with day and the version that holds them."""
    commits = _commits(spark, path)
    if commits.isEmpty():
        return spark.createDataFrame([], DATA)
    # the days are few beside the bars; Spark broadcasts them, by its own threshold, and then reads only their folders
    return spark.read.schema(DATA).parquet(f"{path}/data").join(commits, [*DAY, "version"])


def merge_candles(candles: DataFrame, path: str, order: str = "arrival") -> None:
    """Add ``candles`` (symbol, interval, ts, prices, order) to the store at ``path``: of bars of one time the first to arrive stays.

    What is stored came before what is added; among new rows ``order`` decides.
    Only days that ``candles`` have rows of are written anew. An empty load
    changes nothing.
    """
    spark = candles.sparkSession
    new = candles.select(*SERIES, "ts", "open", "high", "low", "close", F.col(order).alias("_order"), F.lit(1).alias("_load")).withColumn("day", day_id(F.col("ts")).cast("long"))
    new = materialise(new, "load")
    touched = new.select(*DAY).distinct()
    version = (_commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    old = stored_candles(spark, path).join(touched, DAY, "left_semi").select(*SERIES, "ts", "open", "high", "low", "close", F.lit(None).cast(new.schema["_order"].dataType).alias("_order"), F.lit(0).alias("_load"), "day")
    first = F.row_number().over(Window.partitionBy(*SERIES, "ts").orderBy("_load", "_order"))
    merged = old.unionByName(new).withColumn("_n", first).where("_n = 1").drop("_n", "_load", "_order")
    # a load that failed may have left files of this version: those of the same days are replaced, others are never committed
    writer = merged.withColumn("version", F.lit(version)).repartition(*DAY).sortWithinPartitions(*DAY, "ts").write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *DAY).parquet(f"{path}/data")
    touched.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.mode("append").parquet(f"{path}/commits")
