"""Time arithmetic on whole microseconds, so that bucket edges never meet rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US


def window_length(micros: int) -> str:
    return f"{micros} microseconds"


def bucket_number(micros: Column, width: int) -> Column:
    """Epoch-aligned bucket number, rounding down for instants before 1970 too."""
    width = F.lit(width).cast("bigint")
    return F.call_function("div", micros - F.pmod(micros, width), width)


def epoch_seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)
