"""Trailing means and the cut-off after silence on live streams, with results equal to the batch operators.

Rows wait until the watermark has passed them, so that each is worked on in order of time. `lateness` is how far behind
the newest reading a late one may be; later ones are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.schemas import CHANNELS
from driftwatch.streaming.keyed import (
    Columns, KeyState, OrderedRows, TrailingSums, Waiting, as_text, from_text, run_by_key, taken, together)
from driftwatch.streaming.windows import watermarked


class TrailingMeans(OrderedRows):
    """Sums and counts by channel over the range behind each reading."""

    def __init__(self, key: str, columns: list[str], size_us: int, closed: bool, channels: int):
        super().__init__(key, columns)
        self.size_us, self.closed, self.channels = size_us, closed, channels

    def advance(self, state: KeyState, new: Columns | None, watermark_us: int) -> Iterator[Columns]:
        numbers, waiting = state.numbers, Waiting(state.parts("waiting"), state.numbers)
        if new is not None:
            waiting.add(new)
        rows = waiting.due(watermark_us)
        queue = TrailingSums(state.parts("sums"), numbers, self.channels)
        if rows is not None:
            times = rows["ts_us"]
            here = np.zeros((len(times), self.channels), np.int64)
            lane = rows["channel"] if self.channels > 1 else np.zeros(len(times), np.int64)
            here[np.arange(len(times)), lane] = rows["present"] != NULL
            values = np.where(here > 0, rows["reading"][:, None], 0.0)
            sums, counts = queue.push(times, values, here, self.size_us, self.closed)
            numbers["last"] = int(times[-1])
            found = dict(rows)
            for k in range(self.channels):
                found |= {f"sum_{k}": sums[:, k], f"undefined_{k}": np.isnan(sums[:, k]), f"n_{k}": counts[:, k]}
            yield found
        next_row = waiting.earliest()
        if next_row is not None:
            state.wake(next_row)
        elif "last" not in numbers or numbers["last"] + self.size_us < watermark_us:
            # A silent key: no reading to come can have one of these in its range.
            queue.clear()
            numbers.clear()
        else:
            state.wake(numbers["last"] + self.size_us + 1000)


NULL, NUMBER, UNDEFINED = 0, 1, 2


def _trailing(readings: DataFrame, key: str, lanes: list[str], extra: list[str], names: list[str], size_us: int, closed: bool,
              lateness_us: int) -> DataFrame:
    state = F.when(F.col("reading").isNull(), NULL).when(F.isnan("reading"), UNDEFINED).otherwise(NUMBER)
    given = watermarked(readings, lateness_us)
    rows = given.select(key, *lanes, *as_text(given, extra), "ts", "ts_us", "reading", state.alias("present"))
    columns = [*lanes, *extra, "ts_us", "reading", "present"]
    parts = [T.StructField(f"{name}_{k}", kind) for k in range(len(names))
             for name, kind in (("sum", T.DoubleType()), ("undefined", T.BooleanType()), ("n", T.LongType()))]
    carried = [T.StructField(c, rows.schema[c].dataType) for c in columns]
    found = run_by_key(rows, key, TrailingMeans(key, columns, size_us, closed, len(names)), [*carried, *parts])

    def mean(k: int) -> Column:
        total = F.when(F.col(f"undefined_{k}"), F.lit(float("nan"))).otherwise(F.col(f"sum_{k}"))
        return total / F.nullif(F.col(f"n_{k}"), F.lit(0))

    reading = F.when(F.col("present") == NUMBER, F.col("reading")).when(F.col("present") == UNDEFINED, F.lit(float("nan")))
    return found.select(
        key, *lanes, *from_text(given, extra), F.timestamp_micros("ts_us").alias("ts"), "ts_us", reading.alias("reading"),
        *[c for k, name in enumerate(names) for c in (mean(k).alias(name), F.col(f"n_{k}").alias(f"n_{name}"))])


def sensor_trailing_means(readings: DataFrame, size_us: int, lateness_us: int = 0, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per reading, the mean of its sensor over [t - size, t]; `extra` names columns to carry along."""
    return _trailing(readings, "sensor_id", [], list(extra), ["average"], size_us, True, lateness_us)


def motor_trailing_means(readings: DataFrame, size_us: int, lateness_us: int = 0, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per reading, the channel means of its motor over (t - size, t]; an empty channel is null."""
    return _trailing(readings, "motor_id", ["channel"], list(extra), list(CHANNELS), size_us, False, lateness_us)


class LiveReadings(OrderedRows):
    """Passes readings on until the first silence, then none for good.

    The edge is the last reading known to follow the ones before it without a long gap. A reading at most one gap behind the edge
    is connected whatever else arrives, and passes at once. One further ahead, or before the key's first reading is settled,
    waits for the watermark. Once that leaves the edge behind by more than the gap, a mark is all that is kept.
    """

    def __init__(self, key: str, columns: list[str], gap_us: int):
        super().__init__(key, columns)
        self.gap_us = gap_us

    def advance(self, state: KeyState, new: Columns | None, watermark_us: int) -> Iterator[Columns]:
        numbers = state.numbers
        if numbers.get("cut"):
            return
        waiting = Waiting(state.parts("waiting"), numbers)
        fresh = [] if new is None else [new]
        if "edge" not in numbers:
            for rows in fresh:
                waiting.add(rows)
            due = waiting.due(watermark_us)
            if due is None:
                self._again(waiting, state)
                return
            numbers["edge"] = int(due["ts_us"][0])
            fresh = [due]
        # What waits within a gap of the edge, or is due, is looked at with the new rows.
        edge = numbers["edge"]
        held = waiting.due(max(edge + self.gap_us, watermark_us))
        parts = fresh if held is None else [*fresh, held]
        if parts:
            rows = together(parts)
            rows = taken(rows, np.argsort(rows["ts_us"], kind="stable"))
            times = rows["ts_us"]
            reach = np.maximum.accumulate(np.concatenate([[edge], times]))
            broken = np.flatnonzero(times - reach[:-1] > self.gap_us)
            connected = int(broken[0]) if len(broken) else len(times)
            numbers["edge"] = edge = int(reach[connected])
            if connected:
                yield taken(rows, slice(connected))
            if connected < len(times):
                waiting.add(taken(rows, slice(connected, None)))
            # Rows that waited beyond may follow the edge now.
            while (start := waiting.earliest()) is not None and start <= edge + self.gap_us:
                more = waiting.due(edge + self.gap_us)
                numbers["edge"] = edge = max(edge, int(more["ts_us"][-1]))
                yield more
        if edge + self.gap_us < watermark_us:
            for entry in numbers["waiting"]:
                del waiting.parts[entry[0]]
            numbers.clear()
            numbers["cut"] = 1
            return
        self._again(waiting, state)

    def _again(self, waiting: Waiting, state: KeyState) -> None:
        if "edge" in state.numbers:
            state.wake(state.numbers["edge"] + self.gap_us + 1000)
        elif waiting.earliest() is not None:
            state.wake(waiting.earliest())


def live_readings(readings: DataFrame, gap_us: int, lateness_us: int = 0) -> DataFrame:
    """The readings up to each sensor's first gap longer than `gap_us`, with all their columns."""
    given = watermarked(readings, lateness_us)
    carried = [name for name in given.columns if name not in ("sensor_id", "ts", "ts_us")]
    rows = given.select("sensor_id", "ts", "ts_us", *as_text(given, carried))
    outputs = [T.StructField(c, rows.schema[c].dataType) for c in ("ts_us", *carried)]
    found = run_by_key(rows, "sensor_id", LiveReadings("sensor_id", ["ts_us", *carried], gap_us), outputs)
    whole = found.select("sensor_id", F.timestamp_micros("ts_us").alias("ts"), "ts_us", *from_text(given, carried))
    return whole.select(*given.columns)
