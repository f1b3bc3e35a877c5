"""Neighbouring repeats are dropped on a stream, values that come back are kept, whatever the batches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from driftwatch.functions.timegrid import SECOND_US
from driftwatch.streaming.neighbours import changes


def test_changes(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k, draw.randrange(3), 1000 + draw.randrange(120), draw.choice(["A", "B", None]), draw.choice([1.5, None, float("nan")]))
            for k in range(300)]
    late = 40
    order = sorted(rows, key=lambda r: r[2] + draw.random() * (late - 1))
    schema = "event_id bigint, k bigint, second bigint, state string, reading double"
    for part in range(5):
        table = spark.createDataFrame(order[60 * part:60 * part + 60] + [(1000, 99, 10_000, "Z", 0.0)] * (part == 4), schema)
        table.withColumn("ts", F.timestamp_seconds("second")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = changes(source, "k", "state", ["event_id"], late * SECOND_US)
    query = (found.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    want, last = [], {}
    for event, key, second, state, reading in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or last[key] != state:
            want.append((event, key, second, state, repr(reading)))
        last[key] = state
    got = [(r.event_id, r.k, r.second, r.state, repr(r.reading)) for r in spark.table("changes").where("k != 99").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spark.table("changes").columns == source.columns and any(a[3] == b[3] for a in want for b in want if a != b)
