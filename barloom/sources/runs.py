"""The table of saved runs: typed keys, JSON columns, an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["created_at", "symbol", "interval", "start_ms", "end_ms"]
DOCUMENTS = ["strategy", "stats", "metrics", "equity_curve", "trades"]
STATS = "trades long, win_rate_pct double, profit_factor double, total_return_pct double, max_drawdown_pct double, sharpe double"


def run_rows(runs: DataFrame, owner: str = "local") -> DataFrame:
    """Runs with struct or array columns as rows to save: id is a stable hash of the keys and the strategy."""
    kinds = dict(runs.dtypes)
    text = [F.col(c) if kinds[c] == "string" else F.to_json(c).alias(c) for c in DOCUMENTS]
    rows = runs.select(*KEYS, *text, F.lit(owner).alias("owner_id"))
    return rows.select(F.xxhash64(*KEYS, "strategy").alias("id"), "*")


def save_runs(runs: DataFrame, path: str, owner: str = "local") -> None:
    run_rows(runs, owner).write.mode("append").parquet(path)


#: Folders that the runs of a store are dealt to by their id, and the figures that stand beside the documents.
BUCKETS = 32
FIGURES = [f.split() for f in STATS.split(", ")]


def save_by_id(runs: DataFrame, path: str, owner: str = "local") -> None:
    """Save runs with their figures as columns, dealt to folders by id and sorted in them, so that one id is read from one folder."""
    s = F.from_json("stats", STATS)
    rows = run_rows(runs, owner).withColumns({name: s[name] for name, _ in FIGURES}).withColumn("bucket", F.pmod("id", F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("append").partitionBy("bucket").parquet(path)


def read_by_id(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_by_id(runs: DataFrame, limit: int = 100) -> DataFrame:
    """``list_runs`` of a store by id: from columns alone, without any JSON."""
    figures = (F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in FIGURES if c != "profit_factor")
    return runs.select("id", *KEYS, *figures).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def get_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    """``get_run`` of a store by id: one folder is read."""
    return get_run(runs.where(F.col("bucket") == run_id % BUCKETS), run_id).drop("bucket")


def upgrade_runs(runs: DataFrame) -> DataFrame:
    """Old rows get the owner 'local'; applying it again changes nothing."""
    if "owner_id" not in runs.columns:
        return runs.withColumn("owner_id", F.lit("local"))
    return runs.withColumn("owner_id", F.coalesce("owner_id", F.lit("local")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return upgrade_runs(spark.read.option("mergeSchema", True).parquet(path))


def list_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest runs with figures from their stats, 0 where they are missing; the large documents are not read."""
    s = F.from_json("stats", STATS)
    zero = lambda c, z: F.coalesce(s[c], F.lit(z)).alias(c)
    return runs.select("id", *KEYS, zero("trades", 0), *(zero(c, 0.0) for c in ("win_rate_pct", "total_return_pct", "max_drawdown_pct", "sharpe"))).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    """One run; figures of malformed stats are NULL."""
    return runs.where(F.col("id") == run_id).withColumn("stats", F.from_json("stats", STATS))
