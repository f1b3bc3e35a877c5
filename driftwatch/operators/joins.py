"""The relational form of the motor record: averages per sensor, joined outward channel by channel.

The three left joins keep a window whose right side is missing, with null in its columns. Both sides
are aggregates keyed by (motor, window), so after the aggregation the joins move only one row per
sensor and window; their strategy is left to the adaptive planner. All functions accept streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.windows import motor_windows, time_window
from driftwatch.schemas import CHANNELS

KEYS = ["motor_id", "window"]


def channel_windows(readings: DataFrame, channel: str, size_us: int) -> DataFrame:
    """Window averages of one channel."""
    k = CHANNELS.index(channel)
    return (
        readings.where(F.col("channel") == k)
        .groupBy("motor_id", time_window(size_us))
        .agg(F.avg("reading").alias(channel))
    )


def temperature_difference(readings: DataFrame, size_us: int) -> DataFrame:
    air = channel_windows(readings, "air", size_us)
    process = channel_windows(readings, "process", size_us)
    return air.join(process, KEYS, "left").select(
        *KEYS, (F.col("air") - F.col("process")).alias("temperature_difference")
    )


def speed_torque(readings: DataFrame, size_us: int) -> DataFrame:
    """Speed and torque side by side. The product is of the raw units, rpm times Nm."""
    speed = channel_windows(readings, "speed", size_us)
    torque = channel_windows(readings, "torque", size_us)
    return speed.join(torque, KEYS, "left").select(
        *KEYS,
        F.col("speed").alias("rotational_speed"),
        (F.col("speed") * F.col("torque")).alias("speed_torque_product"),
        "torque",
    )


def motor_records_joined(readings: DataFrame, size_us: int) -> DataFrame:
    """Temperature difference left-joined with speed and torque."""
    return temperature_difference(readings, size_us).join(speed_torque(readings, size_us), KEYS, "left")


def motor_records(readings: DataFrame, size_us: int) -> DataFrame:
    """The rows of `motor_records_joined` from one aggregation.

    Every side of the three joins has the key (motor, window), so the chain keeps the windows that
    have air readings and leaves the rest to nulls: speed and torque appear only beside a speed. That
    is a projection of the motor windows, with one scan where the joins need four.
    """
    has_speed = F.col("speed").isNotNull()
    return motor_windows(readings, size_us).where(F.col("air").isNotNull()).select(
        *KEYS,
        (F.col("air") - F.col("process")).alias("temperature_difference"),
        F.col("speed").alias("rotational_speed"),
        (F.col("speed") * F.col("torque")).alias("speed_torque_product"),
        F.when(has_speed, F.col("torque")).alias("torque"),
    )


MOTOR_RECORDS_SQL = """
WITH average AS (
  SELECT motor_id, channel, window(ts, '{size}') AS window, avg(reading) AS mean
  FROM {{readings}} GROUP BY motor_id, channel, window(ts, '{size}')
),
temperature AS (
  SELECT a.motor_id, a.window, a.mean - p.mean AS temperature_difference
  FROM (SELECT * FROM average WHERE channel = 0) a
  LEFT JOIN (SELECT * FROM average WHERE channel = 1) p
    ON a.motor_id = p.motor_id AND a.window = p.window
),
load AS (
  SELECT s.motor_id, s.window, s.mean AS rotational_speed, s.mean * t.mean AS speed_torque_product, t.mean AS torque
  FROM (SELECT * FROM average WHERE channel = 2) s
  LEFT JOIN (SELECT * FROM average WHERE channel = 3) t
    ON s.motor_id = t.motor_id AND s.window = t.window
)
SELECT d.motor_id, d.window, d.temperature_difference, l.rotational_speed, l.speed_torque_product, l.torque
FROM temperature d LEFT JOIN load l ON d.motor_id = l.motor_id AND d.window = l.window
"""


def motor_records_sql(readings: DataFrame, size_us: int) -> DataFrame:
    """`motor_records_joined` written as one SQL statement. No view of the caller's session is touched."""
    text = MOTOR_RECORDS_SQL.format(size=f"{size_us} microseconds")
    return readings.sparkSession.sql(text, readings=readings)
