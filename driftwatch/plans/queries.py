"""The registered queries: one callable (spark, data folder) per operator.

Readings and runs are views of the events table. Window starts are epoch seconds and reading times
epoch seconds with fraction, so results compare without time zones or structs. Averages are rounded on
output only; rules see the full values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch import schemas
from driftwatch.functions.channels import channel_of, motor_of, rad_per_second, sensor_of
from driftwatch.functions.timegrid import DAY_US, HOUR_US, SECOND_US, epoch_seconds
from driftwatch.operators import comparison, joins, latest, liveness, quantiles, resets, trailing, validation, windows
from driftwatch.schemas import CHANNELS
from driftwatch.session import ensure_checkpoint_dir, use_durable_state
from driftwatch.sources.readings import events, events_stream, fan_in, fixture_readings, readings_from_events
from driftwatch.sources.runs import name_parameters, numbered_runs_from_events, runs_from_events
from driftwatch.streaming import neighbours, stateful
from driftwatch.streaming import trailing as live
from driftwatch.streaming import windows as streaming

START_US = 1_704_067_200 * SECOND_US  # 2024-01-01 00:00 UTC
AGE_UNIT_US = 8640 * SECOND_US
CLOSING_ID = -1  # of an event that only moves the watermark

Query = Callable[[SparkSession, str], DataFrame]


def _window_start() -> Column:
    return F.unix_seconds("window.start").alias("window_start")


def _time(column: str = "ts") -> Column:
    return epoch_seconds(F.unix_micros(column)).alias("time")


def _rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(name, digits).alias(name) for name in names]


def motor_alerts_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = windows.confidence_alerts(windows.motor_windows(fixture_readings(spark, sf_dir), DAY_US))
    return alerts.select("motor_id", _window_start(), _time(), "failure")


def motor_alerts_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    motors = windows.motor_windows(fixture_readings(spark, sf_dir), DAY_US)
    alerts = windows.threshold_alerts(motors, START_US, AGE_UNIT_US)
    return alerts.select("motor_id", _window_start(), _time(), "failure")


def motor_window_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    motors = windows.motor_windows(fixture_readings(spark, sf_dir), DAY_US)
    return motors.select("motor_id", _window_start(), *_rounded(*CHANNELS), *windows.COUNTS)


def motor_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    motors = windows.complete(windows.motor_windows(fixture_readings(spark, sf_dir), DAY_US))
    return motors.select("motor_id", _window_start(), "mean_n")


def sensor_window_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = windows.sensor_windows(fixture_readings(spark, sf_dir), 7 * DAY_US)
    return averages.select(
        "sensor_id", _window_start(), *_rounded("average"), "n", _time("max_ts").alias("max_time")
    )


def sensor_sliding_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = windows.sensor_sliding_windows(fixture_readings(spark, sf_dir), 2 * DAY_US, DAY_US)
    return averages.select(
        "sensor_id", _window_start(), *_rounded("average"), "n", _time("max_ts").alias("max_time")
    )


def sensor_tumbling_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = windows.sensor_windows(fixture_readings(spark, sf_dir), DAY_US)
    return averages.select("sensor_id", _window_start(), *_rounded("average"))


def sensor_trailing_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir).select("event_id", "sensor_id", "ts_us", "reading")
    means = trailing.sensor_trailing_means(readings, 2 * DAY_US)
    return means.select("event_id", "sensor_id", *_rounded("average"), F.col("n_average").alias("n"))


def motor_trailing_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir).select("event_id", "motor_id", "channel", "ts_us", "reading")
    means = trailing.motor_trailing_means(readings, 2 * DAY_US)
    return means.select("event_id", "motor_id", *_rounded(*CHANNELS))


def join_temp_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = joins.temperature_difference(fixture_readings(spark, sf_dir), DAY_US)
    return pairs.select("motor_id", _window_start(), *_rounded("temperature_difference"))


def join_speed_torque(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = joins.speed_torque(fixture_readings(spark, sf_dir), DAY_US)
    return pairs.select(
        "motor_id", _window_start(), *_rounded("rotational_speed", "speed_torque_product", "torque")
    )


def _record_columns() -> list[Column]:
    names = ("temperature_difference", "rotational_speed", "speed_torque_product", "torque")
    return [F.col("motor_id"), _window_start(), *_rounded(*names)]


def motor_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.motor_records(fixture_readings(spark, sf_dir), DAY_US).select(*_record_columns())


def motor_join_chain_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.motor_records_sql(fixture_readings(spark, sf_dir), DAY_US).select(*_record_columns())


def latest_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir).select("event_id", "motor_id", "channel", "ts_us", "reading")
    known = latest.latest_values(readings, {"value": F.col("reading")})
    return known.select(
        "event_id", "motor_id", *[F.round(f"value_{name}", 6).alias(name) for name in CHANNELS]
    )


def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir)
    hour = F.call_function("div", F.unix_seconds("ts"), F.lit(HOUR_US // SECOND_US).cast("bigint"))
    first = windows.first_per_bucket(readings, "motor_id", hour, "hour")
    return first.select("motor_id", (F.col("hour") * F.lit(HOUR_US // SECOND_US)).alias("ts_hour"), "event_id")


def window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [days * DAY_US for days in (1, 2, 4, 8)]
    alerts = windows.window_sweep(fixture_readings(spark, sf_dir), sizes)
    days = F.call_function("div", F.col("size_us"), F.lit(DAY_US).cast("bigint"))
    return alerts.select(days.alias("window_days"), "motor_id", _window_start(), "failure")


def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded = windows.run_bounds(events(spark, sf_dir), START_US, 10 * DAY_US)
    return readings_from_events(bounded).select("event_id", "sensor_id", _time())


def sensor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor = F.col("user_id")
    return events(spark, sf_dir).select(
        "event_id", sensor.alias("sensor_id"), motor_of(sensor).alias("motor_id"), channel_of(sensor).alias("channel")
    )


def sensor_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = sensor_decode(spark, sf_dir)
    return decoded.select("event_id", sensor_of(F.col("motor_id"), F.col("channel")).alias("sensor_id"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = fixture_readings(spark, sf_dir).where(F.col("channel") == CHANNELS.index("speed"))
    return speeds.select("event_id", F.round(rad_per_second(F.col("reading")), 6).alias("rad_per_s"))


ALLOWED_TYPES = ("click", "view")


def enum_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.count_by_name(events(spark, sf_dir), "event_type", ALLOWED_TYPES)


def readings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir)
    merged = fan_in([readings.where(F.col("channel") == k) for k in range(len(CHANNELS))])
    return merged.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reading"), 3).alias("total")
    )


def filename_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_from_events(events(spark, sf_dir)).select("motor_groups", "window_ms", "model").distinct()
    parts = ["motor_groups", F.lit(60), "window_ms", "window_ms", F.lit(1), F.lit(400), "model", F.lit("ru.csv")]
    names = runs.select(F.concat_ws("_", *[F.col(p) if isinstance(p, str) else p for p in parts]).alias("file_name"))
    return names.withColumns(name_parameters(F.col("file_name"))).select(
        "file_name", "motor_groups", "window_ms", "model", "dataset"
    )


def run_metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = comparison.run_metrics(numbered_runs_from_events(events(spark, sf_dir)))
    ids = ["motor_groups", "window_ms", "model", "run_no"]
    return comparison.long_metrics(runs, ids).select("metric", *ids, *_rounded("value"))


def metric_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = comparison.run_metrics(runs_from_events(events(spark, sf_dir)))
    keys = ["motor_groups", "window_ms", "model"]
    samples = comparison.long_metrics(runs, keys)
    summary = quantiles.five_number_summary(samples, ["metric", *keys])
    return summary.select("metric", *keys, *_rounded(*quantiles.SUMMARY, digits=9)).orderBy(
        "metric", *[F.asc_nulls_first(k) for k in keys]
    )


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.alert_counts(runs_from_events(events(spark, sf_dir)), ["motor_groups", "window_ms", "model"])


def _t_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = comparison.run_metrics(numbered_runs_from_events(events(spark, sf_dir)))
    return comparison.paired_t_test(comparison.paired_differences(runs))


def paired_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Means of short decimals often end in the digit 5, where decimal rounding is a coin toss between
    # engines; single precision has no such ties.
    single = [F.round(name, 12).cast("float").alias(name) for name in ("mean_diff", "sd_diff", "t")]
    return _t_tests(spark, sf_dir).select("metric", *comparison.CONFIG, "direction", "n", *single, *_rounded("p"))


def model_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.verdicts(_t_tests(spark, sf_dir))


def sensor_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = liveness.sensor_liveness(fixture_readings(spark, sf_dir), 2 * DAY_US)
    return report.select("sensor_id", "kept", "dropped", epoch_seconds(F.col("cut_us")).alias("cut_time"))


def alert_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = windows.confidence_alerts(windows.motor_windows(fixture_readings(spark, sf_dir), DAY_US))
    return windows.with_delay(alerts).select("motor_id", _window_start(), *_rounded("delay"))


def _throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resets.throttled_averages(fixture_readings(spark, sf_dir), 2 * DAY_US, DAY_US, START_US)


def throttled_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throttled(spark, sf_dir).select(
        "sensor_id", epoch_seconds(F.col("ts_us")).alias("time"), *_rounded("average"), "n"
    )


def alerts_latest_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = _throttled(spark, sf_dir).select(
        motor_of(F.col("sensor_id")).alias("motor_id"),
        channel_of(F.col("sensor_id")).alias("channel"),
        "ts_us",
        "average",
        "n",
    )
    return resets.alerts_latest_reset(averages, START_US).select("motor_id", _time(), "failure")


def alerts_trailing_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir)
    alerts = resets.alerts_trailing_reset(readings, 2 * DAY_US, START_US, AGE_UNIT_US)
    return alerts.select("motor_id", _time(), "failure")


def alerts_age_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fixture_readings(spark, sf_dir)
    alerts = resets.alerts_age_strain(readings, DAY_US, START_US, AGE_UNIT_US)
    return alerts.select("motor_id", _time(), "failure")


def _replayed(spark: SparkSession, sf_dir: str, name: str, size_us: int,
              form: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over the readings present, close its last windows and read back what it wrote.

    Once the readings are through, one closing event two windows later moves the watermark past every window but
    its own, which stays open and is not written. The stream has a session of its own so that its settings stay with it; it keeps
    its number of state partitions for life, and one per core suits the whole cluster. Results stay in the folder
    shared by the executors, next to the stream's own checkpoint.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    session = spark.newSession()
    use_durable_state(session)
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    present = events(session, sf_dir)
    after = F.max("ts") + F.expr(f"INTERVAL '{2 * size_us // 1_000_000}' SECOND")
    closing = present.agg(after.alias("ts")).where("ts IS NOT NULL").select(
        F.lit(0).cast("bigint").alias("event_id"), "ts", F.lit(0).cast("bigint").alias("user_id"),
        F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    closing.limit(0).write.parquet(f"{folder}/closing")
    last = session.readStream.schema(schemas.EVENTS).parquet(f"{folder}/closing")
    stream = form(readings_from_events(events_stream(session, sf_dir).unionByName(last)))
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
    writer = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    closing.write.mode("append").parquet(f"{folder}/closing")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_motor_alerts_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    def form(readings: DataFrame) -> DataFrame:
        return streaming.confidence_alerts(readings, DAY_US).select("motor_id", _window_start(), _time(), "failure")

    return _replayed(spark, sf_dir, "alerts", DAY_US, form)


def stream_sensor_sliding_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sensor_id", _window_start(), *_rounded("average"), "n", _time("max_ts").alias("max_time")]
    return _replayed(spark, sf_dir, "sliding", 2 * DAY_US,
                     lambda readings: streaming.sensor_averages(readings, 2 * DAY_US, DAY_US).select(*columns))


def stream_motor_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, "records", DAY_US,
                     lambda readings: streaming.motor_records_joined(readings, DAY_US).select(*_record_columns()))


SLICES = 5
SLICE_FILE_ROWS = 1_000_000


def _replayed_in_slices(spark: SparkSession, sf_dir: str, name: str, after_us: int,
                        form: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Run a stream over the readings in slices of time, about a micro-batch for each, and read back what it wrote.

    The slices are written one after the other, so the stream finds them in this order; the files of a slice may come in any, so
    the watermark stays a slice behind. A slice is as many files as the cluster has cores, and more where files would be long; a
    micro-batch takes that many, so their number follows the rows, not the files of the table. A closing event moves it past everything else; its own rows are left out. form: makes
    the stream from readings and lateness.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    session = spark.newSession()
    use_durable_state(session)
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    present = events(session, sf_dir).where("ts IS NOT NULL")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = present.agg(F.min(micros), F.max(micros)).first()
    width = 1 if first is None else (last - first) // SLICES + 1
    files = spark.sparkContext.defaultParallelism
    present.limit(0).write.parquet(f"{folder}/events")
    for k in range(0 if first is None else SLICES):
        edge = first + k * width
        part = present.where((micros >= edge) & (micros < edge + width)).repartition(files)
        part.write.option("maxRecordsPerFile", SLICE_FILE_ROWS).mode("append").parquet(f"{folder}/events")
    closing = session.range(1).select(
        F.lit(CLOSING_ID).alias("event_id"), F.timestamp_micros(F.lit((last or 0) + width + after_us)).cast("timestamp_ntz").alias("ts"),
        F.lit(CLOSING_ID).alias("user_id"), F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"),
        F.lit(None).cast("string").alias("props"))
    closing.write.mode("append").parquet(f"{folder}/events")
    source = session.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files).parquet(f"{folder}/events")
    stream = form(readings_from_events(source), width)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    key = next(name for name in ("event_id", "sensor_id", "motor_id") if name in rows.columns)
    return rows.where(F.col(key) != CLOSING_ID)


def stream_sensor_trailing_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _replayed_in_slices(
        spark, sf_dir, "sensor-trailing", 3 * DAY_US,
        lambda readings, late: live.sensor_trailing_means(readings, 2 * DAY_US, late, extra=("event_id",)))
    return means.select("event_id", "sensor_id", *_rounded("average"), F.col("n_average").alias("n"))


def stream_motor_trailing_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _replayed_in_slices(
        spark, sf_dir, "motor-trailing", 3 * DAY_US,
        lambda readings, late: live.motor_trailing_means(readings, 2 * DAY_US, late, extra=("event_id",)))
    return means.select("event_id", "motor_id", *_rounded(*CHANNELS))


def stream_live_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _replayed_in_slices(spark, sf_dir, "live", 3 * DAY_US, lambda readings, late: live.live_readings(readings, 2 * DAY_US, late))
    return kept.select("event_id", "sensor_id", _time(), *_rounded("reading"))


def stream_consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def form(readings: DataFrame, late: int) -> DataFrame:
        return neighbours.changes(readings, "motor_id", "channel", ["sensor_id", "event_id"], late)

    return _replayed_in_slices(spark, sf_dir, "changes", DAY_US, form).select("motor_id", "event_id", "channel", _time())


def stream_throttled_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = _replayed_in_slices(
        spark, sf_dir, "throttled", 3 * DAY_US,
        lambda readings, late: stateful.throttled_averages(readings, 2 * DAY_US, DAY_US, START_US, late))
    return averages.select("sensor_id", epoch_seconds(F.col("ts_us")).alias("time"), *_rounded("average"), "n")


def stream_alerts_latest_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _replayed_in_slices(
        spark, sf_dir, "latest-reset", 3 * DAY_US,
        lambda readings, late: stateful.alerts_from_readings(readings, 2 * DAY_US, DAY_US, START_US, late))
    return alerts.select("motor_id", _time(), "failure")


def stream_alerts_trailing_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _replayed_in_slices(
        spark, sf_dir, "trailing-reset", 3 * DAY_US,
        lambda readings, late: stateful.alerts_trailing_reset(readings, 2 * DAY_US, START_US, AGE_UNIT_US, late))
    return alerts.select("motor_id", _time(), "failure")


def stream_alerts_age_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _replayed_in_slices(
        spark, sf_dir, "age-strain", 3 * DAY_US,
        lambda readings, late: stateful.alerts_age_strain(readings, DAY_US, START_US, AGE_UNIT_US, late))
    return alerts.select("motor_id", _time(), "failure")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        motor_alerts_ci,
        motor_alerts_threshold,
        motor_window_pivot,
        motor_complete,
        sensor_window_avg,
        sensor_sliding_avg,
        sensor_tumbling_avg,
        sensor_trailing_avg,
        motor_trailing_avg,
        join_temp_diff,
        join_speed_torque,
        motor_join_chain,
        motor_join_chain_sql,
        latest_per_channel,
        consecutive_dedup,
        window_sweep,
        run_bounds,
        sensor_decode,
        sensor_encode,
        unit_convert,
        enum_validate,
        readings_union,
        filename_params,
        run_metric_long,
        metric_quartiles,
        alert_counts,
        paired_ttest,
        model_verdict,
        sensor_liveness,
        alert_delay,
        throttled_avg,
        alerts_latest_reset,
        alerts_trailing_reset,
        alerts_age_strain,
        stream_motor_alerts_ci,
        stream_sensor_sliding_avg,
        stream_motor_join_chain,
        stream_sensor_trailing_avg,
        stream_motor_trailing_avg,
        stream_live_readings,
        stream_consecutive_dedup,
        stream_throttled_avg,
        stream_alerts_latest_reset,
        stream_alerts_trailing_reset,
        stream_alerts_age_strain,
    )
}
