"""Sensor identifiers and units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwatch.schemas import CHANNELS


def motor_of(sensor_id: Column) -> Column:
    return F.shiftright(sensor_id, 2)


def channel_of(sensor_id: Column) -> Column:
    return sensor_id.bitwiseAND(F.lit(3).cast("bigint"))


def sensor_of(motor_id: Column, channel: Column) -> Column:
    return F.shiftleft(motor_id, 2) + channel


def position(ts_us: Column, channel: Column) -> Column:
    """Order of a motor's readings as one number: time first, then sensor.

    The low three bits hold channel + 1, so `start_us * 8` sorts before every reading at the start
    and `position >> 3` gives the time back.
    """
    return F.shiftleft(ts_us, 3) + channel + F.lit(1)


def rad_per_second(rpm):
    return rpm / 60.0 * math.pi * 2.0


def per_channel(value: Column, channel: Column | None = None) -> dict[str, Column]:
    """One nullable column per channel, filled only on rows of that channel."""
    channel = F.col("channel") if channel is None else channel
    return {name: F.when(channel == k, value) for k, name in enumerate(CHANNELS)}


def all_present(names=CHANNELS) -> Column:
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
    return present
