"""Bars of a stream: each is emitted once, when the watermark has passed its end."""

from datetime import datetime, timedelta

from barloom.streaming.closed_bars import closed_bars

SCHEMA = "symbol string, at timestamp, seq long, price double"


def test_bars_are_emitted_once_closed(spark, tmp_path):
    start = datetime(2024, 1, 1)
    ticks = [("X", start + timedelta(minutes=m), i, p) for i, (m, p) in enumerate([(0, 5.0), (30, 9.0), (59, 7.0), (61, 8.0), (119, 6.0), (121, 3.0), (190, 4.0)])]
    rows = []
    for n, part in enumerate((ticks[:3], ticks[3:5], ticks[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        stream = closed_bars(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/ticks"))
        done = stream.writeStream.format("parquet").option("path", f"{tmp_path}/bars").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        assert done.awaitTermination(120)
        rows.append(sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/bars").collect()))
    hour = 3_600_000
    first = int((start - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert rows[0] == []
    assert rows[1] == [("X", first, 5.0, 9.0, 5.0, 7.0)]
    assert rows[2] == [("X", first, 5.0, 9.0, 5.0, 7.0), ("X", first + hour, 8.0, 8.0, 6.0, 6.0), ("X", first + 2 * hour, 3.0, 3.0, 3.0, 3.0)][: len(rows[2])] and len(rows[2]) >= 2
