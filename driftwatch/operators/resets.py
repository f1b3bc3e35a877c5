"""Operators whose results depend on earlier results: throttled averages and alerts with reset.

Each is one step function over time-ordered rows and the position of the last pick. The batch form here
runs it per (key, chunk) through `chunked_scan`; `driftwatch.streaming.stateful` runs the same function
per micro-batch.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.channels import all_present, position, rad_per_second
from driftwatch.functions.rules import (
    ConfidenceRule,
    ThresholdRule,
    confidence_failure,
    first_failure_array,
    mean_count,
)
from driftwatch.functions.timegrid import SECOND_US, bucket_number
from driftwatch.operators.chunkscan import Columns, chunked_scan, first_fresh, first_true, repeat_numbers
from driftwatch.operators.joins import motor_records
from driftwatch.operators.latest import latest_values
from driftwatch.operators.splitting import ROWS_PER_TASK
from driftwatch.schemas import CHANNELS
from driftwatch.session import ensure_checkpoint_dir

# Throttled averages --------------------------------------------------------------------------------

def throttle_step(rows: Columns, last: int, interval_us: int) -> Columns:
    """Report at the first reading at least `interval_us` after the last report.

    Position is the time in microseconds.
    """
    ts = rows["ts_us"]
    reports = []
    while True:
        i = int(np.searchsorted(ts, last + interval_us, "left"))
        if i >= len(ts):
            return {"position": reports}
        last = int(ts[i])
        reports.append(last)


def throttled_means_step(rows: Columns, last: int, size_us: int, interval_us: int) -> Columns:
    """`throttle_step` with the averages, for rows that come with the last `size_us` in front."""
    ts, x = rows["ts_us"], rows["reading"]
    at = np.array(throttle_step(rows, last, interval_us)["position"], dtype="int64")
    begin, end = np.searchsorted(ts, at - size_us, "left"), np.searchsorted(ts, at, "right")
    means = [float(x[b:e].mean()) for b, e in zip(begin, end)]
    return {"position": at, "average": means, "n": end - begin}


def range_averages(readings: DataFrame, reports: DataFrame, size_us: int, pane_us: int) -> DataFrame:
    """Mean and count of the sensor's readings in [position - size, position] for every report.

    Time is cut into panes. Single readings are compared only with the ranges that begin or end in their
    pane, which are few when reports are at least a pane apart. The panes between enter as rolling totals,
    of one of two lengths, depending on where in its pane a range begins.
    """
    until = F.col("position")
    since = until - F.lit(size_us)
    first, last = bucket_number(since, pane_us), bucket_number(until, pane_us)
    values = readings.select("sensor_id", bucket_number(F.col("ts_us"), pane_us).alias("pane"), "ts_us", "reading")

    edges = reports.withColumn("pane", F.explode(F.array_distinct(F.array(first, last))))
    parts = (
        values.join(edges, ["sensor_id", "pane"])
        .where((F.col("ts_us") <= until) & (F.col("ts_us") >= since))
        .select("sensor_id", "position", F.col("reading").alias("total"), F.lit(1).cast("bigint").alias("n"))
    )
    most = size_us // pane_us
    if most:
        lengths = [length for length in (most - 1, most) if length]
        rolling = []
        for length in lengths:
            before = Window.partitionBy("sensor_id").orderBy("pane").rangeBetween(-length, -1)
            rolling += [F.sum("total").over(before).alias(f"total_{length}"), F.sum("n").over(before).alias(f"n_{length}")]
        totals = values.groupBy("sensor_id", "pane").agg(F.sum("reading").alias("total"), F.count("reading").alias("n"))
        between = last - first - F.lit(1)

        def chosen(name: str) -> Column:
            return F.coalesce(*[F.when(between == length, F.col(f"{name}_{length}")) for length in lengths])

        ended = reports.withColumn("pane", last).join(totals.select("sensor_id", "pane", *rolling), ["sensor_id", "pane"])
        inner = ended.select("sensor_id", "position", chosen("total").alias("total"), chosen("n").alias("n"))
        parts = parts.unionByName(inner.where(F.col("n") > 0))
    return parts.groupBy("sensor_id", "position").agg(
        (F.sum("total") / F.sum("n")).alias("average"), F.sum("n").alias("n")
    )


def throttled_averages(readings: DataFrame, size_us: int, interval_us: int, start_us: int,
                       rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Sensor averages reported on arrival, at most once per interval: sensor_id, ts_us, average, n.

    A report covers the readings of [t - size, t]. Report times come from a scan over the times alone.
    """
    step = partial(throttle_step, interval_us=interval_us)
    times = readings.select("sensor_id", "ts_us")
    reports = chunked_scan(times, "sensor_id", step, "", start_us, "ts_us", rows_per_task=rows_per_task)
    # Read by several branches below, and few beside the readings.
    ensure_checkpoint_dir(readings.sparkSession)
    averages = range_averages(readings, reports.checkpoint(), size_us, interval_us)
    return averages.withColumnRenamed("position", "ts_us")


# Latest averages with reset ------------------------------------------------------------------------

LATEST_ALERT = "alert_us bigint, failure string"


def latest_reset_step(rows: Columns, last: int) -> Columns:
    """Pick candidates whose four channels have all reported since the last alert.

    An alert clears the slots. Until then a slot holds the channel's last average, so the values at a
    candidate are the last known ones, provided the oldest of them (`oldest`) is newer than the alert.
    `oldest` never decreases, so the next alert is found by bisection.
    """
    positions, oldest = rows["position"], rows["oldest"]
    picks = []
    while True:
        i = int(np.searchsorted(oldest, last, "right"))
        if i >= len(oldest):
            break
        picks.append(i)
        last = int(positions[i])
    return {name: rows[name][picks] for name in ("position", "alert_us", "failure")}


def latest_slots_step(rows: Columns, last: int, rule: ConfidenceRule = ConfidenceRule()) -> Columns:
    """`latest_reset_step` on plain averages, for rows that come with each channel's last one in front."""
    count = len(rows["position"])
    seen = [np.maximum.accumulate(np.where(rows["channel"] == k, np.arange(count), -1)) for k in range(len(CHANNELS))]
    at = np.flatnonzero((np.min(seen, axis=0) >= 0) & rows["fresh"])
    slots = [s[at] for s in seen]
    n = sum(rows["n"][s] for s in slots) // len(CHANNELS)
    with np.errstate(divide="ignore", invalid="ignore"):
        failure = first_failure_array(rule.conditions(*[rows["average"][s] for s in slots], n, np))
    fires = np.flatnonzero(failure != "")
    at = at[fires]
    candidates = {
        "position": rows["position"][at],
        "oldest": rows["position"][np.min([s[fires] for s in slots], axis=0)] if len(at) else at,
        "alert_us": rows["ts_us"][at],
        "failure": failure[fires],
    }
    return latest_reset_step(candidates, last)


def last_per_channel(rows: Columns) -> Columns:
    """The rows that `latest_slots_step` needs in front of the next ones."""
    keep = sorted(int(np.flatnonzero(rows["channel"] == k)[-1]) for k in np.unique(rows["channel"]))
    kept = {name: values[keep] for name, values in rows.items()}
    return {**kept, "fresh": np.zeros(len(keep), bool)}


def latest_reset_candidates(averages: DataFrame, rule: ConfidenceRule, rows_per_task: int) -> DataFrame:
    """Updates at which the last known averages break the rule: position, oldest, alert_us, failure."""
    slots = latest_values(
        averages,
        {"average": F.col("average"), "n": F.col("n"), "pos": position(F.col("ts_us"), F.col("channel"))},
        rows_per_task,
    )
    counts = [F.col(f"n_{name}") for name in CHANNELS]
    positions = [F.col(f"pos_{name}") for name in CHANNELS]
    failure = confidence_failure(*[F.col(f"average_{name}") for name in CHANNELS], mean_count(counts), rule)
    return (
        slots.where(all_present([f"average_{name}" for name in CHANNELS]))
        .select(
            "motor_id",
            "ts_us",
            position(F.col("ts_us"), F.col("channel")).alias("position"),
            F.least(*positions).alias("oldest"),
            F.shiftright(F.greatest(*positions), 3).alias("alert_us"),
            failure.alias("failure"),
        )
        .where(F.col("failure").isNotNull())
    )


def alerts_latest_reset(averages: DataFrame, start_us: int, rule: ConfidenceRule = ConfidenceRule(),
                        rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Confidence alerts on the last average of each channel; an alert forgets all four.

    `averages` has motor_id, channel, ts_us, average, n.
    """
    # Both are read more than once and small beside the readings they come from.
    ensure_checkpoint_dir(averages.sparkSession)
    candidates = latest_reset_candidates(averages.checkpoint(), rule, rows_per_task).checkpoint()
    picks = chunked_scan(candidates, "motor_id", latest_reset_step, LATEST_ALERT, start_us << 3, "position",
                         rows_per_task=rows_per_task)
    return picks.select("motor_id", F.timestamp_micros("alert_us").alias("ts"), "failure")


# Trailing ranges with reset ------------------------------------------------------------------------

TRAILING_ALERT = "failure string"


class _RangeMeans:
    """Means of one channel over index ranges. Sums of halves, quarters and so on of the rows are only ever added up.

    A huge, infinite or missing reading so touches no range that does not hold it.
    """

    def __init__(self, mask: np.ndarray, x: np.ndarray):
        self.counts = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])
        self.levels = [np.where(mask, x, 0.0)]
        with np.errstate(over="ignore", invalid="ignore"):
            while len(self.levels[-1]) > 1:
                below = self.levels[-1]
                self.levels.append(np.add.reduceat(below, np.arange(0, len(below), 2)))

    def over(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[end] - self.counts[begin]
        total = np.zeros(len(n))
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            for sums in self.levels:
                left, right = (begin < end) & (begin & 1 > 0), (begin < end) & (end & 1 > 0)
                total[left] += sums[begin[left]]
                begin = begin + left
                right &= begin < end
                total[right] += sums[end[right] - 1]
                begin, end = begin >> 1, (end - right) >> 1
            return total / n, n


def trailing_reset_step(rows: Columns, last: int, size_us: int, age_unit_us: int,
                        rule: ThresholdRule = ThresholdRule(), repeat: int = 0) -> Columns:
    """Test every reading's trailing range (t - size, t] of all four channels; an alert empties it.

    The age that strain grows with is counted from the last alert. Position orders a motor's readings; those that
    repeat a sensor and time follow each other by value. The last alert came with the `repeat`-th of its position, so the repeats
    behind that one still count.
    """
    positions, ts, channel, x = (rows[name] for name in ("position", "ts_us", "channel", "reading"))
    n = len(ts)
    means = [_RangeMeans(channel == k, x) for k in range(len(CHANNELS))]
    oldest = np.searchsorted(ts, ts - size_us, "right")

    def failures(begin: int, end: int, cleared: int, since: int) -> np.ndarray:
        lower = np.maximum(oldest[begin:end], cleared)
        upper = np.arange(begin + 1, end + 1)
        values, counts = zip(*[m.over(lower, upper) for m in means])
        air, process, speed, torque = values
        age = (ts[begin:end] - since) / age_unit_us
        with np.errstate(invalid="ignore"):
            conditions = rule.conditions(air - process, speed, torque * rad_per_second(speed), age * torque, np)
        filled = np.min(counts, axis=0) > 0
        return np.where(filled, first_failure_array(conditions), "")

    picks, names = [], []
    i = first_fresh(rows)
    cleared = min(int(np.searchsorted(positions, last, "left")) + repeat, int(np.searchsorted(positions, last, "right")))
    while i < n:
        since = last >> 3
        i = first_true(lambda b, e: failures(b, e, cleared, since) != "", max(i, cleared), n)
        if i < n:
            picks.append(i)
            names.append(str(failures(i, i + 1, cleared, since)[0]))
            last = int(positions[i])
            i += 1
            cleared = i
    return {"position": positions[picks], "repeat": repeat_numbers(positions, picks), "failure": names}


def alerts_trailing_reset(readings: DataFrame, size_us: int, start_us: int, age_unit_us: int = SECOND_US,
                          rule: ThresholdRule = ThresholdRule(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Threshold alerts on trailing ranges, tested at every reading and reset by every alert."""
    rows = readings.select(
        "motor_id", "channel", "ts_us", "reading", position(F.col("ts_us"), F.col("channel")).alias("position")
    )
    step = partial(trailing_reset_step, size_us=size_us, age_unit_us=age_unit_us, rule=rule)
    picks = chunked_scan(rows, "motor_id", step, TRAILING_ALERT, start_us << 3, "position",
                         lookback_us=size_us, rows_per_task=rows_per_task, ties=["reading"])
    ts = F.timestamp_micros(F.shiftright("position", 3))
    return picks.select("motor_id", ts.alias("ts"), "failure")


# Age since the last alert --------------------------------------------------------------------------

AGE_ALERT = "window_us bigint, failure string"


def age_strain_step(rows: Columns, last: int, age_unit_us: int, rule: ThresholdRule = ThresholdRule()) -> Columns:
    """Test window records in order; strain is torque times the age since the last alert's window end.

    Position is the window end in microseconds.
    """
    ends, starts = rows["position"], rows["window_us"]
    diff, speed, torque = (rows[c] for c in ("temperature_difference", "rotational_speed", "torque"))
    power = torque * rad_per_second(speed)

    def failures(begin: int, end: int, since: int) -> np.ndarray:
        part = slice(begin, end)
        strain = torque[part] * ((ends[part] - since) / age_unit_us)
        return first_failure_array(rule.conditions(diff[part], speed[part], power[part], strain, np))

    picks, names = [], []
    i, n = 0, len(ends)
    while i < n:
        i = first_true(lambda b, e: failures(b, e, last) != "", i, n)
        if i < n:
            picks.append(i)
            names.append(str(failures(i, i + 1, last)[0]))
            last = int(ends[i])
            i += 1
    return {"position": ends[picks], "window_us": starts[picks], "failure": names}


def age_strain_records(readings: DataFrame, size_us: int) -> DataFrame:
    """Complete window records in the form the step reads."""
    columns = ["temperature_difference", "rotational_speed", "torque"]
    return motor_records(readings, size_us).where(all_present(columns)).select(
        "motor_id",
        F.unix_micros("window.start").alias("window_us"),
        F.unix_micros("window.end").alias("position"),
        *columns,
    )


def alerts_age_strain(readings: DataFrame, size_us: int, start_us: int, age_unit_us: int = SECOND_US,
                      rule: ThresholdRule = ThresholdRule(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Threshold alerts on window records, with the age reset by every alert.

    The alert time is the window start. Readings are folded into windows first, so a motor has one row
    per window however many readings it has.
    """
    ensure_checkpoint_dir(readings.sparkSession)
    records = age_strain_records(readings, size_us).withColumn("ts_us", F.col("window_us")).checkpoint()
    step = partial(age_strain_step, age_unit_us=age_unit_us, rule=rule)
    picks = chunked_scan(records, "motor_id", step, AGE_ALERT, start_us, "position", rows_per_task=rows_per_task)
    return picks.select("motor_id", F.timestamp_micros("window_us").alias("ts"), "failure")

