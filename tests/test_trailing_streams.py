"""Trailing means and the cut-off on streams: rows out of order within the lateness, equal times, nulls, silent keys, bounded state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.timegrid import SECOND_US
from driftwatch.operators.liveness import live_readings
from driftwatch.operators.trailing import motor_trailing_means, sensor_trailing_means
from driftwatch.streaming import trailing as live

SCHEMA = "event_id bigint, sensor_id bigint, motor_id bigint, channel bigint, ts timestamp, ts_us bigint, reading double"
LATE = 30 * SECOND_US
GAP = 8 * SECOND_US


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Six files of readings that come up to half a minute late; sensors 4 and 5 fall silent, and a last file far ahead."""
    draw = random.Random(11)
    rows = []
    for sensor in range(4):
        t = 1_700_000_000 + draw.randrange(20)
        for _ in range(70):
            t += draw.choice([0, 1, 1, 2, 3, 5, 8, 9 if sensor else 8])
            rows.append((t, sensor, draw.choice([1.5, 2.0, 300.25, None, float("nan") if sensor == 2 else 7.0])))
    rows += [(1_700_000_000 + k, 4, 1.0) for k in range(20)] + [(1_700_000_003, 5, 2.0), (1_700_000_100, 5, 3.0)]
    order = sorted(rows, key=lambda r: r[0] + draw.random() * LATE / SECOND_US * 0.9)
    path = str(tmp_path_factory.mktemp("late") / "rows")
    parts = [order[k:k + len(order) // 6 + 1] for k in range(0, len(order), len(order) // 6 + 1)]
    parts.append([(1_800_000_000, 999, 0.0)])
    for n, part in enumerate(parts):
        data = [(1000 * n + k, s, t * SECOND_US, x) for k, (t, s, x) in enumerate(part)]
        table = spark.createDataFrame(data, "event_id bigint, sensor_id bigint, ts_us bigint, reading double").select(
            "event_id", "sensor_id", F.shiftright("sensor_id", 2).alias("motor_id"), F.col("sensor_id").bitwiseAND(3).alias("channel"),
            F.timestamp_micros("ts_us").alias("ts"), "ts_us", "reading")
        table.coalesce(1).write.mode("append").parquet(path)
    return path


def _drained(spark, folder, name, form, tmp_path):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (form(source).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 6
    state = sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 0
    return spark.table(name).where("sensor_id != 999" if "sensor_id" in spark.table(name).columns else "motor_id != 249"), state


def _rows(df, columns):
    rounded = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c in columns]
    return sorted(map(repr, (tuple(r) for r in df.select(*rounded).collect())))


def test_sensor_means(spark, folder, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(folder).where("sensor_id != 999")
    columns = ["event_id", "sensor_id", "ts_us", "reading", "average", "n_average"]
    want = sensor_trailing_means(batch.select("event_id", "sensor_id", "ts_us", "reading"), 10 * SECOND_US).select(*columns)
    got, _ = _drained(spark, folder, "sensor_means",
                      lambda s: live.sensor_trailing_means(s, 10 * SECOND_US, LATE, extra=("event_id",)), tmp_path)
    assert _rows(got.select(*columns), columns) == _rows(want, columns)


def test_motor_means_and_silent_motors(spark, folder, tmp_path):
    """Motors silent for longer than the range keep no state: what is left belongs to the closing row's motor."""
    batch = spark.read.schema(SCHEMA).parquet(folder).where("sensor_id != 999")
    columns = ["event_id", "motor_id", "channel", "air", "process", "speed", "torque", "n_air", "n_torque"]
    want = motor_trailing_means(batch.select("event_id", "motor_id", "channel", "ts_us", "reading"), 7 * SECOND_US).select(*columns)
    got, state = _drained(spark, folder, "motor_means",
                          lambda s: live.motor_trailing_means(s, 7 * SECOND_US, LATE, extra=("event_id",)), tmp_path)
    assert _rows(got.select(*columns), columns) == _rows(want, columns)
    assert state <= 4  # header, waiting row, and timer entries of the closing row


def test_cut_off(spark, folder, tmp_path):
    """What follows a gap is dropped for good, and a cut sensor keeps one mark."""
    batch = spark.read.schema(SCHEMA).parquet(folder).where("sensor_id != 999")
    columns = ["event_id", "sensor_id", "ts_us", "reading"]
    want = live_readings(batch, GAP).select(*columns)
    assert 0 < want.count() < batch.count()
    got, state = _drained(spark, folder, "cut", lambda s: live.live_readings(s, GAP, LATE), tmp_path)
    assert got.columns == SCHEMA.replace(" bigint", "").replace(" timestamp", "").replace(" double", "").split(", ")
    assert _rows(got.select(*columns), columns) == _rows(want, columns)
    assert state <= batch.select("sensor_id").distinct().count() + 4
