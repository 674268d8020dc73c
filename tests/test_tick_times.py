"""Ticks on the edges of bars, and several within a millisecond, against the SQL."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.plans import registry
from barloom.sources.adapters import millis

from .test_entry import plain

EPOCH = datetime(1970, 1, 1)
MICROS = [0, 1, 499, 500, 501, 999, 1499, 1500, -1, -499, -500, -501, -999, -1499, -1500, 1_705_000_000_000_500, 9_223_372_036_854_499]


def test_milliseconds_are_the_nearest(spark):
    import duckdb

    want = [duckdb.sql(f"SELECT epoch_ms(make_timestamp({us}))").fetchall()[0][0] for us in MICROS]
    rows = spark.createDataFrame([(i, EPOCH + timedelta(microseconds=us), (EPOCH + timedelta(microseconds=us)).replace(tzinfo=UTC)) for i, us in enumerate(MICROS)], "i int, plain timestamp_ntz, zoned timestamp")
    got = rows.select("i", millis(rows, "plain").alias("p"), millis(rows, "zoned").alias("z")).orderBy("i").collect()
    assert [r["p"] for r in got] == want
    assert [r["z"] for r in got] == want


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Five days of two symbols: each hour and each 900 s of B3 has ticks just before its start, and ids that run against time within a millisecond."""
    first, rows = datetime(2024, 1, 15), []
    offsets = [-700, -499, -300, 200, 400, 1_800_000_000, 3_599_990_100, 3_599_990_300, 3_599_990_450]
    for hour in range(120):
        for symbol in ("click", "view"):
            for k, us in enumerate(offsets):
                at = first + timedelta(hours=hour, microseconds=us)
                rows.append((at, symbol, float((hour * 37 + k * 53 + len(symbol) * 11) % 101)))
        # 1705000000000 is 400 s after a quarter of an hour
        rows.append((first + timedelta(hours=hour, seconds=400, microseconds=-400), "click", 50.0))
    numbered = [(len(rows) - i, *r) for i, r in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("edges"))
    events = spark.createDataFrame(numbered, "event_id long, ts timestamp_ntz, event_type string, value double")
    events.withColumns({"user_id": F.lit(1).cast("long"), "props": F.lit("{}")}).write.parquet(f"{path}/events.parquet")
    return path


#: The queries that are held against their SQL here.
CHECKED = ["a0_candles", "a1_read_klines", "a2_read_candles_csv", "a3_late_candles", "b3_align_start", "c1_sma", "c1_split_sma", "c2_ema", "c2_split_ema", "c3_rsi", "c3_split_rsi", "e1_order_fill_price", "e2_bracket_levels", "e4_resolve_exit"]


@pytest.mark.parametrize("name", CHECKED)
def test_edges(spark, edges, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{edges}/events.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in registry.queries()[name](spark, edges).collect()) == want
