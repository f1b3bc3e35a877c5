"""Sensor readings from JSON lines, value files and the events table.

Readers of JSON lines and of the event table return `sensor_id`, `motor_id`, `channel`, `ts`, `ts_us` (epoch
microseconds) and `reading` as double; the event table adds `event_id`. Value files hold no ids or times, so they
give `reading` and `channel` alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch import schemas
from driftwatch.functions.channels import channel_of, motor_of
from driftwatch.session import pin_utc


def _decoded(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra,
        "sensor_id",
        motor_of(F.col("sensor_id")).alias("motor_id"),
        channel_of(F.col("sensor_id")).alias("channel"),
        "ts",
        F.unix_micros("ts").alias("ts_us"),
        F.col("reading").cast("double").alias("reading"),
    )


def parse_json_readings(lines: DataFrame, column: str = "value") -> DataFrame:
    """Readings from a string column holding one JSON object each, as a message queue delivers them.

    Lines without sensor, time or reading are left out; `rejected_json_readings` returns them.
    """
    return _decoded(_json_fields(lines, column).where(_complete()).drop("line"))


def rejected_json_readings(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines (line) that are no readings: not JSON, or without sensor, time or reading."""
    return _json_fields(lines, column).where(~_complete()).select("line")


def _json_fields(lines: DataFrame, column: str) -> DataFrame:
    line = F.col(column).cast("string")
    parsed = lines.select(line.alias("line"), F.from_json(line, schemas.READING_JSON).alias("r"))
    return parsed.select("line", "r.sensor_id", F.try_to_timestamp("r.ts").alias("ts"), "r.reading")


def _complete() -> Column:
    return F.col("sensor_id").isNotNull() & F.col("ts").isNotNull() & F.col("reading").isNotNull()


def json_readings(spark: SparkSession, folder: str) -> DataFrame:
    pin_utc(spark)
    return parse_json_readings(spark.read.text(folder))


def json_readings_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    pin_utc(spark)
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_json_readings(reader.text(folder))


def format_json_readings(readings: DataFrame) -> DataFrame:
    """The producer's line form: RFC 3339 time with milliseconds, reading, sensor id."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return readings.select(
        F.to_json(F.struct(stamp.alias("ts"), F.col("reading"), F.col("sensor_id"))).alias("value")
    )


def value_file_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Files with one float per line; the file stem is the channel."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1)
    lines = spark.read.option("pathGlobFilter", "*.txt").text(folder)
    return lines.select(
        F.trim("value").try_cast("float").cast("double").alias("reading"),
        stem.try_cast("bigint").alias("channel"),
    ).where(F.col("reading").isNotNull() & F.col("channel").isNotNull())


def fan_in(parts: list[DataFrame]) -> DataFrame:
    """Merge the readings of several connections."""
    return reduce(DataFrame.unionByName, parts)


def channel_value(channel: Column, value: Column) -> Column:
    """Fixture scaling: spread an event value around each channel's operating point."""
    z = (value - 50.0) / 50.0
    scaled = (
        F.when(channel == 0, 300.0 + 2.0 * z)
        .when(channel == 1, 310.0 + 1.5 * z)
        .when(channel == 2, 1538.3 + 179.0 * z)
        .otherwise(40.0 + 10.0 * z)
    )
    return scaled.cast("float").cast("double")


def readings_from_events(events: DataFrame) -> DataFrame:
    """View the events table as readings. Works on static and streaming tables."""
    sensors = events.select(
        "event_id",
        F.col("user_id").alias("sensor_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        channel_value(channel_of(F.col("user_id")), F.col("value")).alias("reading"),
    )
    return _decoded(sensors, "event_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    # The pattern finds the table as one file and as a folder of many.
    return spark.readStream.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet*")


def fixture_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(events(spark, sf_dir))

