"""Streaming forms of the order-dependent operators, on the same step functions as the batch forms.

Rows wait in keyed state until the watermark has passed them, so a step always sees a key's rows in time
order, whatever batch they came in. Kept per key: waiting rows, the rows the step looks back at, and the
position of the last pick. Keys share state in buckets (`streaming.keyed`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions.channels import all_present, channel_of, motor_of, position
from driftwatch.functions.rules import ConfidenceRule, ThresholdRule
from driftwatch.functions.timegrid import SECOND_US
from driftwatch.operators import resets
from driftwatch.operators.chunkscan import Columns, Step, appended, recent
from driftwatch.operators.windows import motor_windows
from driftwatch.schemas import CHANNELS
from driftwatch.streaming.keyed import KeyState, OrderedRows, Waiting, run_by_key, taken
from driftwatch.streaming.windows import watermarked


class OrderedScan(OrderedRows):
    """Runs a step over each key's rows in time order."""

    def __init__(self, step: Step, columns: list[str], order: str, start: int, key: str, outputs: list[str],
                 keep: Callable[[Columns], Columns] | None, event_time: bool = False, ties: str | None = None):
        super().__init__(key, columns)
        self.event_time, self.ties = event_time, ties
        self.step, self.order, self.start = step, order, start
        self.outputs, self.keep = outputs, keep

    def advance(self, state: KeyState, new: Columns | None, watermark_us: int) -> Iterator[Columns]:
        waiting = Waiting(state.parts("waiting"), state.numbers)
        if new is not None:
            waiting.add(new)
        rows = waiting.due(watermark_us)
        if waiting.earliest() is not None:
            state.wake(waiting.earliest())
        if rows is None:
            return
        # Rows of one position follow each other by value where ties count, as in a table.
        rows = taken(rows, np.lexsort([rows[self.ties], rows[self.order]]) if self.ties else np.argsort(rows[self.order], kind="stable"))
        rows["fresh"] = np.ones(len(rows["ts_us"]), bool)
        history = state.parts("history")
        seen = appended(pickle.loads(history[0]) if 0 in history else None, rows)
        last, repeat = state.numbers.get("last", (self.start, 0))
        found = self.step(seen, last, repeat=repeat) if self.ties else self.step(seen, last)
        if len(found["position"]):
            state.numbers["last"] = int(found["position"][-1]), int(found["repeat"][-1]) if self.ties else 0
            picks = {name: np.asarray(found[name]) for name in self.outputs}
            if self.event_time:
                picks["ts"] = picks["position"].astype("datetime64[us]").astype("datetime64[ns]")
            yield picks
        if self.keep:
            history[0] = pickle.dumps(self.keep(seen), pickle.HIGHEST_PROTOCOL)


def _scan(rows: DataFrame, key: str, columns: list[str], step: Step, order: str, start: int, picks: str,
          keep: Callable[[Columns], Columns] | None = None, event_time: bool = False, ties: str | None = None) -> DataFrame:
    """With `event_time`, picks carry `ts` (from a position in microseconds) for a stateful operator above."""
    outputs = list(T.StructType.fromDDL(picks).fields)
    processor = OrderedScan(step, columns, order, start, key, [field.name for field in outputs], keep, event_time, ties)
    if not event_time:
        return run_by_key(rows, key, processor, outputs)
    return run_by_key(rows, key, processor, [*outputs, T.StructField("ts", T.TimestampType())], "ts")


def _throttled(readings: DataFrame, size_us: int, interval_us: int, start_us: int, lateness_us: int,
               event_time: bool) -> DataFrame:
    rows = watermarked(readings, lateness_us).select("sensor_id", "ts", "ts_us", "reading")
    step = partial(resets.throttled_means_step, size_us=size_us, interval_us=interval_us)
    return _scan(rows, "sensor_id", ["ts_us", "reading"], step, "ts_us", start_us,
                 "position bigint, average double, n bigint", partial(recent, lookback_us=size_us), event_time)


def throttled_averages(readings: DataFrame, size_us: int, interval_us: int, start_us: int,
                       lateness_us: int = 0) -> DataFrame:
    """sensor_id, ts_us, average, n; equal to the batch operator once the watermark has passed."""
    picks = _throttled(readings, size_us, interval_us, start_us, lateness_us, event_time=False)
    return picks.withColumnRenamed("position", "ts_us")


def _latest_reset(averages: DataFrame, start_us: int, rule: ConfidenceRule) -> DataFrame:
    channel = F.coalesce("channel", F.lit(-1).cast("bigint"))  # of no motor; with nulls whole numbers would lose digits in pandas
    rows = averages.withColumn("channel", channel).select(
        "motor_id", "channel", "ts", "ts_us", "average", "n",
        position(F.col("ts_us"), F.col("channel")).alias("position"),
    )
    step = partial(resets.latest_slots_step, rule=rule)
    picks = _scan(rows, "motor_id", ["position", "ts_us", "channel", "average", "n"], step, "position",
                  start_us << 3, resets.LATEST_ALERT, resets.last_per_channel)
    return picks.select("motor_id", F.timestamp_micros("alert_us").alias("ts"), "failure")


def alerts_latest_reset(averages: DataFrame, start_us: int, lateness_us: int = 0,
                        rule: ConfidenceRule = ConfidenceRule()) -> DataFrame:
    """Alerts on the last average of each channel, from a stream of motor_id, channel, ts, ts_us, average, n."""
    return _latest_reset(watermarked(averages, lateness_us), start_us, rule)


def alerts_from_readings(readings: DataFrame, size_us: int, interval_us: int, start_us: int, lateness_us: int = 0,
                         rule: ConfidenceRule = ConfidenceRule()) -> DataFrame:
    """Throttled averages per sensor feeding alerts on the last averages per motor, in one query."""
    averages = _throttled(readings, size_us, interval_us, start_us, lateness_us, event_time=True)
    return _latest_reset(
        averages.select(
            motor_of(F.col("sensor_id")).alias("motor_id"), channel_of(F.col("sensor_id")).alias("channel"),
            "ts", F.col("position").alias("ts_us"), "average", "n",
        ),
        start_us,
        rule,
    )


def alerts_trailing_reset(readings: DataFrame, size_us: int, start_us: int, age_unit_us: int = SECOND_US,
                          lateness_us: int = 0, rule: ThresholdRule = ThresholdRule()) -> DataFrame:
    """Alerts on trailing ranges; the state of a motor is the readings of one range."""
    channel = F.coalesce("channel", F.lit(-1).cast("bigint"))  # of no motor; with nulls whole numbers would lose digits in pandas
    rows = watermarked(readings, lateness_us).withColumn("channel", channel).select(
        "motor_id", "channel", "ts", "ts_us", "reading",
        position(F.col("ts_us"), F.col("channel")).alias("position"),
    )
    step = partial(resets.trailing_reset_step, size_us=size_us, age_unit_us=age_unit_us, rule=rule)
    picks = _scan(rows, "motor_id", ["position", "ts_us", "channel", "reading"], step, "position",
                  start_us << 3, "position bigint, failure string", partial(recent, lookback_us=size_us), ties="reading")
    ts = F.timestamp_micros(F.shiftright("position", 3))
    return picks.select("motor_id", ts.alias("ts"), "failure")


def alerts_age_strain(readings: DataFrame, size_us: int, start_us: int, age_unit_us: int = SECOND_US,
                      lateness_us: int = 0, rule: ThresholdRule = ThresholdRule()) -> DataFrame:
    """Alerts on closed windows with the age reset by every alert."""
    closed = motor_windows(watermarked(readings, lateness_us), size_us).where(all_present(CHANNELS))
    rows = closed.select(
        "motor_id",
        F.window_time("window").alias("ts"),
        F.unix_micros("window.start").alias("window_us"),
        F.unix_micros("window.end").alias("position"),
        F.unix_micros(F.window_time("window")).alias("ts_us"),
        (F.col("air") - F.col("process")).alias("temperature_difference"),
        F.col("speed").alias("rotational_speed"),
        "torque",
    )
    step = partial(resets.age_strain_step, age_unit_us=age_unit_us, rule=rule)
    columns = ["position", "window_us", "ts_us", "temperature_difference", "rotational_speed", "torque"]
    picks = _scan(rows, "motor_id", columns, step, "position", start_us, resets.AGE_ALERT)
    return picks.select("motor_id", F.timestamp_micros("window_us").alias("ts"), "failure")
