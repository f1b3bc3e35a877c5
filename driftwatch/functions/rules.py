"""The two rule sets that turn averages into failures.

Each rule lists its conditions once, in the order they are tested. The conditions use only operators
and `abs`, `sqrt`, `isnan`, which `pyspark.sql.functions` and numpy both provide; `xp` selects between
Columns (batch and stream expressions) and arrays (inside keyed state).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwatch.functions.channels import rad_per_second
from driftwatch.schemas import HEAT_DISSIPATION, OVERSTRAIN, POWER


@dataclass(frozen=True)
class ConfidenceRule:
    """Averages must stay inside a 90% confidence interval whose width shrinks with the sample count."""

    # Measured means and deviations and the two-sided 90% critical value.
    temp_diff_mean: float = 10.00063
    temp_diff_sd: float = 2.49035776174829
    power_mean: float = 6443.50092908344
    power_sd: float = 1782.92606670628
    critical: float = 1.64

    def conditions(self, air, process, speed, torque, n, xp=F):
        temp_gap = xp.abs(xp.abs(air - process) - self.temp_diff_mean)
        power_gap = xp.abs(torque * rad_per_second(speed) - self.power_mean)
        root = xp.sqrt(n)
        # Spark orders NaN above every number, so a NaN gap must be excluded by hand.
        return (
            (HEAT_DISSIPATION, ~xp.isnan(temp_gap) & (temp_gap > self.critical * self.temp_diff_sd / root)),
            (POWER, ~xp.isnan(power_gap) & (power_gap > self.critical * self.power_sd / root)),
        )


@dataclass(frozen=True)
class ThresholdRule:
    """Fixed physical limits on temperature difference, power and accumulated strain."""

    # Limits of the failure modes.
    min_temp_diff: float = 8.6
    min_speed: float = 1380.0
    min_power: float = 3500.0
    max_power: float = 9000.0
    max_strain: float = 11000.0

    def conditions(self, temp_diff, speed, power, strain, xp=F):
        return (
            (HEAT_DISSIPATION, (xp.abs(temp_diff) < self.min_temp_diff) & (speed < self.min_speed)),
            (POWER, ~((power >= self.min_power) & (power <= self.max_power))),
            (OVERSTRAIN, ~xp.isnan(strain) & (strain > self.max_strain)),
        )


def first_failure(conditions: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, null when none does."""
    (name, condition), *rest = conditions
    chain = F.when(condition, F.lit(name))
    for name, condition in rest:
        chain = chain.when(condition, F.lit(name))
    return chain


def first_failure_array(conditions) -> np.ndarray:
    """Array form of `first_failure`; the empty string stands for no failure."""
    names, flags = zip(*conditions)
    return np.select(flags, names, default="")


def confidence_failure(air: Column, process: Column, speed: Column, torque: Column, n: Column,
                       rule: ConfidenceRule = ConfidenceRule()) -> Column:
    """No samples mean an unbounded interval, hence no failure."""
    return first_failure(rule.conditions(air, process, speed, torque, F.nullif(n, F.lit(0))))


def threshold_failure(air: Column, process: Column, speed: Column, torque: Column, age: Column,
                      rule: ThresholdRule = ThresholdRule()) -> Column:
    """`age` is the time since start or last alert, in the unit the strain limit is meant for."""
    power = torque * rad_per_second(speed)
    return first_failure(rule.conditions(air - process, speed, power, age * torque))


def mean_count(counts: Sequence[Column]) -> Column:
    """Mean of the channel counts, dropping the fraction."""
    total = counts[0]
    for count in counts[1:]:
        total = total + count
    return F.call_function("div", total, F.lit(len(counts)).cast("bigint"))
