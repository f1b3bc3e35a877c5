"""Rows that differ from the row before them, on live streams.

`dropDuplicatesWithinWatermark` drops every repeat; here only neighbours are compared, so a value that comes back passes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.streaming.keyed import Columns, KeyState, OrderedRows, Waiting, as_text, from_text, run_by_key, taken
from driftwatch.streaming.windows import watermarked


class Changes(OrderedRows):
    """Keeps the last value of a key, and the rows that the watermark has not passed."""

    def __init__(self, key: str, columns: list[str], order: list[str], value: str):
        super().__init__(key, columns)
        self.order, self.value = order, value

    def advance(self, state: KeyState, new: Columns | None, watermark_us: int) -> Iterator[Columns]:
        numbers, waiting = state.numbers, Waiting(state.parts("waiting"), state.numbers)
        if new is not None:
            waiting.add(new)
        rows = waiting.due(watermark_us)
        if rows is not None:
            rows = taken(rows, np.lexsort([rows[name] for name in reversed(["ts_us", *self.order])]))
            values = [None if pd.isna(v) else v for v in rows[self.value].tolist()]
            before = [numbers["value"] if "value" in numbers else object(), *values[:-1]]
            numbers["value"] = values[-1]
            changed = np.array([a != b for a, b in zip(values, before)])
            if changed.any():
                yield taken(rows, changed)
        if waiting.earliest() is not None:
            state.wake(waiting.earliest())


def changes(rows: DataFrame, key: str, value: str, order: list[str], lateness_us: int = 0) -> DataFrame:
    """The rows of a key whose `value` is not that of the row before, read in the order of `ts` and then of `order`.

    order: whole-number columns without nulls. Null is a value of its own. All columns are kept; state is the last value of a
    key and the rows within the lateness.
    """
    given = watermarked(rows.withColumn("ts_us", F.unix_micros("ts")), lateness_us)
    carried = [name for name in rows.columns if name not in (key, "ts", "ts_us", *order)]
    plain = given.select(key, "ts", "ts_us", *order, *as_text(given, carried))
    columns = ["ts_us", *order, *carried]
    outputs = [T.StructField(c, plain.schema[c].dataType) for c in columns]
    found = run_by_key(plain, key, Changes(key, columns, order, value), outputs)
    whole = found.select(key, F.timestamp_micros("ts_us").alias("ts"), "ts_us", *order, *from_text(given, carried))
    return whole.select(*rows.columns)
