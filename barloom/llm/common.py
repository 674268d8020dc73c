"""What several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none, and in local mode alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        named = sc.getCheckpointDir()
    return named


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, columns stay prunable."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one or two numbers that may be broadcast; larger sides are shuffled instead.
MAX_BROADCAST = 400_000


def only(df: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``wanted``: by broadcast if that was counted as small, else by a shuffled join."""
    small = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return df.join(F.broadcast(wanted) if small else wanted, on, "left_semi")


def known_join(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with rows of a few numbers, ``other``: by broadcast if that was counted as small, else by a shuffle."""
    small = other.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return df.join(F.broadcast(other) if small else other, on, how)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores before it as no frame has a column of that name, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def place(df: DataFrame, group: list[str], order: list[str], name: str = "pos", size: str | None = None) -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row in its ``group`` in ascending ``order``, and ``size``, the rows of the group.

    Groups of any size are spread over tasks: the rows are range-sorted by group
    and order and written with their number in their part; what moves then is one
    row for each part and group. NULLs come first and are a group of their own.
    Rows that are equal in ``order`` have any of their places.
    """
    at, part = free_name("at", df), free_name("part", df)
    inner = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = stash(inner.withColumn(at, F.monotonically_increasing_id()), "place").withColumn(part, F.shiftright(at, 33))
    runs = rows.groupBy(part, *group).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("n").over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [f"_run{i}" for i in range(len(group) + 1)]
    runs = runs.select(*(F.col(c).alias(k) for c, k in zip([part, *group], keys, strict=True)), (before - F.col("first")).alias("_shift"), F.sum("n").over(whole).alias("_size"))
    if runs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        runs = F.broadcast(runs)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([part, *group], keys, strict=True)]
    placed = rows.join(runs, same).withColumn(name, F.col(at) + F.col("_shift"))
    return placed.select(*df.columns, name, *([F.col("_size").alias(size)] if size else []))
