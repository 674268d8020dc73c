"""Opens within a rounding of a trailing level against the SQL of E4."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.operators import backtest
from barloom.plans import registry

from .test_entry import plain


def test_an_open_just_below_a_level_is_no_exit(spark, tmp_path):
    import duckdb

    # bars 25 on are a short trade: its low of 100.2 makes a level of 105.21000000000001, and 105.21 does not reach it
    values = [20.0] * 25 + [10.0, 0.2, 5.21]
    rows = [(i, datetime(2024, 1, 15) + timedelta(hours=i, minutes=5), "click", v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()["e4_resolve_exit"])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in registry.queries()["e4_resolve_exit"](spark, str(tmp_path)).collect())
    assert got == want
    assert ("CLICK1", "27", "None", "None") in got


def test_levels_of_trades_are_rounded(spark):
    path = spark.createDataFrame([("a", 0, -1, 110.0, 110.0, 100.2)], "trade string, idx int, sign int, entry_price double, high double, low double")
    assert backtest.trailing_levels(path, 5.0).first()["level"] == 105.21
    assert backtest.trailing_levels(path, 5.0, None).select(F.col("level") > 105.21).first()[0]
