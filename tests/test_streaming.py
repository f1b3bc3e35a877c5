"""Streams fed from files give the batch results, however the rows are spread over the batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.timegrid import DAY_US
from driftwatch.operators import joins, resets, windows
from driftwatch.operators.liveness import sensor_liveness
from driftwatch.plans.queries import AGE_UNIT_US, START_US
from driftwatch.sinks.alerts import push_alerts, replace_batch, stream_alert_log
from driftwatch.sources.readings import fixture_readings, format_json_readings, json_readings, json_readings_stream
from driftwatch.sources.runs import alert_log
from driftwatch.streaming import stateful
from driftwatch.streaming import windows as streaming

FAR_AHEAD = "2024-06-01T00:00:00.000Z"
CLOSING_KEY = 1000


@pytest.fixture(scope="module")
def reading_files(spark, sf_dir, tmp_path_factory):
    """Four JSON files in time order, and a last one whose only reading closes all windows."""
    folder = str(tmp_path_factory.mktemp("readings"))
    lines = format_json_readings(fixture_readings(spark, sf_dir).orderBy("ts")).collect()
    size = len(lines) // 4 + 1
    for i in range(4):
        with open(f"{folder}/part-{i}.json", "w") as out:
            out.writelines(line.value + "\n" for line in lines[i * size:(i + 1) * size])
    with open(f"{folder}/part-9.json", "w") as out:
        out.write('{"ts": "%s", "reading": 300.0, "sensor_id": 4000}\n' % FAR_AHEAD)
    return folder


@pytest.fixture(scope="module")
def batch(spark, reading_files):
    return json_readings(spark, reading_files).where(F.col("sensor_id") < 4000)


@pytest.fixture()
def stream(spark, reading_files):
    return json_readings_stream(spark, reading_files, max_files=1)


def drained(df, name: str, tmp_path) -> list[tuple]:
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    result = df.sparkSession.table(name)
    key = next(name for name in ("motor_id", "sensor_id") if name in result.columns)
    return sorted(tuple(row) for row in result.where(F.col(key) < CLOSING_KEY).collect())


def rows(df) -> list[tuple]:
    return sorted(tuple(row) for row in df.collect())


def test_confidence_alerts(stream, batch, tmp_path):
    expected = rows(windows.confidence_alerts(windows.motor_windows(batch, DAY_US)))
    assert len(expected) == 7
    assert drained(streaming.confidence_alerts(stream, DAY_US), "ci", tmp_path) == expected


def test_sliding_averages(stream, batch, tmp_path):
    expected = rows(windows.sensor_windows(batch, 2 * DAY_US, DAY_US).select("window", "sensor_id", "n", "max_ts"))
    actual = streaming.sensor_averages(stream, 2 * DAY_US, DAY_US).select("window", "sensor_id", "n", "max_ts")
    assert drained(actual, "sliding", tmp_path) == expected


def _open(df):
    """Rows as comparable tuples with nulls made sortable."""
    return df.select(*[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) if t == "double" else c for c, t in df.dtypes])


def test_left_join(stream, batch, tmp_path):
    expected = rows(_open(joins.temperature_difference(batch, DAY_US)))
    actual = drained(_open(streaming.temperature_difference(stream, DAY_US)), "joined", tmp_path)
    assert actual == expected


def test_motor_records(stream, batch, tmp_path):
    expected = rows(_open(joins.motor_records_joined(batch, DAY_US)))
    assert expected == rows(_open(joins.motor_records(batch, DAY_US)))
    assert drained(_open(streaming.motor_records(stream, DAY_US)), "records", tmp_path) == expected
    assert drained(_open(streaming.motor_records_joined(stream, DAY_US)), "records_joined", tmp_path) == expected


def test_dedup(stream, batch, tmp_path):
    hourly = stream.withColumn("ts", F.date_trunc("hour", "ts")).select("motor_id", "ts")
    expected = rows(batch.select("motor_id", F.date_trunc("hour", "ts")).distinct())
    actual = drained(streaming.deduplicated(hourly, DAY_US), "dedup", tmp_path)
    assert actual == expected


def test_live_sessions(stream, batch, tmp_path):
    sessions = drained(
        streaming.live_sessions(stream, 2 * DAY_US).select("sensor_id", "first_ts", "n"), "sessions", tmp_path
    )
    first = {}
    for sensor, _, n in sessions:
        first.setdefault(sensor, n)
    kept = {r.sensor_id: r.kept for r in sensor_liveness(batch, 2 * DAY_US).collect()}
    assert first == kept


def test_throttled_averages(stream, batch, tmp_path):
    expected = rows(resets.throttled_averages(batch, 2 * DAY_US, DAY_US, START_US).withColumn("average", F.round("average", 6)))
    actual = stateful.throttled_averages(stream, 2 * DAY_US, DAY_US, START_US).withColumn("average", F.round("average", 6))
    assert drained(actual, "throttled", tmp_path) == expected


def test_alerts_trailing_reset(stream, batch, tmp_path):
    expected = rows(resets.alerts_trailing_reset(batch, 2 * DAY_US, START_US, AGE_UNIT_US))
    assert expected
    actual = stateful.alerts_trailing_reset(stream, 2 * DAY_US, START_US, AGE_UNIT_US, lateness_us=DAY_US)
    assert drained(actual, "trailing", tmp_path) == expected


def test_alerts_age_strain(stream, batch, tmp_path):
    expected = rows(resets.alerts_age_strain(batch, DAY_US, START_US, AGE_UNIT_US))
    assert expected
    assert drained(stateful.alerts_age_strain(stream, DAY_US, START_US, AGE_UNIT_US), "strain", tmp_path) == expected


def test_alerts_latest_reset(spark, batch, tmp_path):
    averages = resets.throttled_averages(batch, 2 * DAY_US, DAY_US, START_US).select(
        F.shiftright("sensor_id", 2).alias("motor_id"), F.col("sensor_id").bitwiseAND(F.lit(3)).alias("channel"),
        F.timestamp_micros("ts_us").alias("ts"), "ts_us", "average", "n",
    )
    expected = rows(resets.alerts_latest_reset(averages, START_US))
    assert expected
    folder = str(tmp_path / "averages")
    far = averages.limit(1).withColumn("motor_id", F.lit(1000).cast("bigint")).withColumn(
        "ts", F.lit(FAR_AHEAD).cast("timestamp")).withColumn("ts_us", F.unix_micros("ts"))
    averages.coalesce(1).write.mode("append").parquet(folder)
    far.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(averages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert drained(stateful.alerts_latest_reset(stream, START_US, lateness_us=60 * DAY_US), "latest", tmp_path) == expected


def test_alerts_from_readings(spark, stream, batch, tmp_path):
    averages = resets.throttled_averages(batch, 2 * DAY_US, DAY_US, START_US).select(
        F.shiftright("sensor_id", 2).alias("motor_id"), F.col("sensor_id").bitwiseAND(F.lit(3)).alias("channel"),
        "ts_us", "average", "n",
    )
    expected = rows(resets.alerts_latest_reset(averages, START_US))
    actual = stateful.alerts_from_readings(stream, 2 * DAY_US, DAY_US, START_US)
    assert drained(actual, "chained", tmp_path) == expected


def test_alert_sinks(spark, stream, batch, tmp_path):
    expected = {(r.motor_id, r.failure) for r in windows.confidence_alerts(windows.motor_windows(batch, DAY_US)).collect()}
    alerts = streaming.confidence_alerts(stream, DAY_US)
    stream_alert_log(alerts, str(tmp_path / "log"), str(tmp_path / "c1"), available_now=True).awaitTermination()
    log = alert_log(spark, str(tmp_path / "log")).collect()
    assert {(r.motor_id, r.failure) for r in log} == expected
    assert all(r.delay > 0 for r in log)
    push_alerts(alerts, replace_batch(str(tmp_path / "push")), str(tmp_path / "c2"), available_now=True).awaitTermination()
    pushed = alert_log(spark, str(tmp_path / "push") + "/*").collect()
    assert sorted((r.motor_id, r.time) for r in pushed) == sorted((r.motor_id, r.time) for r in log)
