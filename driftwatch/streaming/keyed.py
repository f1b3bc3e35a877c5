"""Keyed state for streams that need a key's rows in time order: waiting rows, and sums over a trailing range.

Keys share state in buckets, as calls to the state store and frames cost more than the rows of a key that has few: a bucket's
keys are read, worked on, written and handed on together. What a key keeps stays in the bucket while it is small. A key that keeps
more has it in parts of many rows; a batch touches the parts that the watermark has passed and those at the edges of the range, not
what lies between.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

PART_ROWS = 4096
WAITING_ROWS = 1024
BUCKETS = 256  # of a stream, for life
SMALL_BYTES = 65_536  # of a key in its bucket
BUCKET = "_bucket_of_keys"


Columns = dict[str, np.ndarray]


def columns_of(frames: list[pd.DataFrame], names: list[str]) -> Columns:
    """A key's rows of one batch as arrays; pandas costs more than the rows where a key has few."""
    return {name: np.concatenate([frame[name].to_numpy() for frame in frames]) for name in names}


def taken(columns: Columns, rows: np.ndarray | slice) -> Columns:
    return {name: values[rows] for name, values in columns.items()}


def together(parts: list[Columns]) -> Columns:
    if len(parts) == 1:
        return parts[0]
    return {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}


class Parts(MutableMapping):
    """Binary parts of a key by number: in its bucket, or each for itself in a map state once they are many bytes."""

    def __init__(self, small: dict[int, bytes], large: set[int], state: MapState, owner: str):
        self.small, self.large, self.state, self.owner = small, large, state, owner

    def __getitem__(self, part: int) -> bytes:
        if part in self.large:
            return bytes(self.state.getValue((self.owner, part))[0])
        return self.small[part]

    def __setitem__(self, part: int, data: bytes) -> None:
        if part in self.large:
            self.state.updateValue((self.owner, part), (data,))
        else:
            self.small[part] = data

    def __delitem__(self, part: int) -> None:
        if part in self.large:
            self.state.removeKey((self.owner, part))
            self.large.remove(part)
        else:
            del self.small[part]

    def __iter__(self) -> Iterator[int]:
        return iter([*self.small, *self.large])

    def __len__(self) -> int:
        return len(self.small) + len(self.large)

    def spread(self) -> None:
        for part, data in self.small.items():
            self.state.updateValue((self.owner, part), (data,))
        self.large.update(self.small)
        self.small.clear()


class KeyState:
    """What a bucket keeps of one key: a few numbers, parts by name, and when it is to be called without new rows."""

    def __init__(self, key: str | None, record: dict, state: MapState):
        self.key, self.record, self.state = key, record, state
        self.numbers: dict = record.setdefault("numbers", {})
        self.record["wake"] = None

    def parts(self, name: str) -> Parts:
        small, large = self.record.setdefault(name, ({}, set()))
        return Parts(small, large, self.state, name if self.key is None else f"{name}={self.key}")

    def wake(self, time_us: int) -> None:
        self.record["wake"] = -(-time_us // 1000)

    def settle(self) -> bool:
        """Spread parts that are many bytes; whether anything is left to keep."""
        named = [name for name in self.record if name not in ("numbers", "wake")]
        if sum(len(data) for name in named for data in self.record[name][0].values()) > SMALL_BYTES:
            for name in named:
                self.parts(name).spread()
        return bool(self.numbers) or any(self.record[name][k] for name in named for k in (0, 1))


class Waiting:
    """Rows the watermark has not passed, in parts of rows that follow each other in time.

    A part is read when its first row is due; the rows of it that are not are put back, together with those of other parts.

    numbers: what is kept in the header: number and earliest time of each part.
    """

    def __init__(self, parts: MutableMapping, numbers: dict):
        self.parts, self.numbers = parts, numbers
        self.index: list[list[int]] = numbers.setdefault("waiting", [])

    def add(self, rows: Columns) -> None:
        rows = taken(rows, np.argsort(rows["ts_us"], kind="stable"))
        for at in range(0, len(rows["ts_us"]), WAITING_ROWS):
            part = taken(rows, slice(at, at + WAITING_ROWS))
            number = self.numbers.get("next_part", 0)
            self.numbers["next_part"] = number + 1
            self.parts[number] = pickle.dumps(part, pickle.HIGHEST_PROTOCOL)
            self.index.append([number, int(part["ts_us"][0])])

    def due(self, watermark_us: int) -> Columns | None:
        """Take out the rows up to the watermark, in order of time; None if there are none."""
        reached = [entry for entry in self.index if entry[1] <= watermark_us]
        if not reached:
            return None
        found = []
        for entry in reached:
            found.append(pickle.loads(self.parts[entry[0]]))
            del self.parts[entry[0]]
            self.index.remove(entry)
        rows = together(found)
        rows = taken(rows, np.argsort(rows["ts_us"], kind="stable"))
        ready = int(np.searchsorted(rows["ts_us"], watermark_us, "right"))
        if ready < len(rows["ts_us"]):
            self.add(taken(rows, slice(ready, None)))
        return taken(rows, slice(ready))

    def earliest(self) -> int | None:
        return min((entry[1] for entry in self.index), default=None)


class TrailingSums:
    """Sums and counts over a trailing range as a queue of two stacks.

    Readings enter at the back, which has one running sum. The front holds readings in their order with, for each, the sum from
    it to the front's end. Readings that leave the range leave the front's beginning. When the back's oldest reading is to leave, the
    front is empty, and the back becomes the front. So a reading is added once to the back's sum and once on the way to
    the front; nothing is ever subtracted, and a NaN leaves with its reading.

    parts: stores of front and back. numbers: the header; the queue keeps `front` and `back` (lists of part number and first
    and last time), `sums` and `counts` of the back there.
    """

    def __init__(self, parts: MutableMapping, numbers: dict, channels: int):
        self.parts, self.numbers, self.channels = parts, numbers, channels
        numbers.setdefault("front", [])
        numbers.setdefault("back", [])
        numbers.setdefault("sums", [0.0] * channels)
        numbers.setdefault("counts", [0] * channels)

    def _write(self, times: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> list[list[int]]:
        entries = []
        for at in range(0, len(times), PART_ROWS):
            some = slice(at, at + PART_ROWS)
            number = self.numbers.get("next_sum", 0)
            self.numbers["next_sum"] = number + 1
            self.parts[number] = b"".join(a[some].tobytes() for a in (times, sums, counts))
            entries.append([number, int(times[some][0]), int(times[some][-1])])
        return entries

    def _read(self, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, columns = self.channels, ([np.zeros(0, np.int64)], [np.zeros((0, self.channels))], [np.zeros((0, self.channels), np.int64)])
        for number, _, _ in entries:
            data = self.parts[number]
            rows = len(data) // (8 * (1 + 2 * k))
            columns[0].append(np.frombuffer(data, np.int64, rows))
            columns[1].append(np.frombuffer(data, np.float64, rows * k, 8 * rows).reshape(rows, k))
            columns[2].append(np.frombuffer(data, np.int64, rows * k, 8 * rows * (1 + k)).reshape(rows, k))
        return tuple(np.concatenate(c) for c in columns)

    def _flip(self, lower: int) -> None:
        """Make the back the front, without readings up to `lower`, part by part from the newest on."""
        for number, _, _ in self.numbers["front"]:
            del self.parts[number]
        front: list[list[int]] = []
        carried, carried_n = np.zeros((1, self.channels)), np.zeros((1, self.channels), np.int64)
        for entry in reversed(self.numbers["back"]):
            times, values, counts = self._read([entry])
            del self.parts[entry[0]]
            keep = times > lower
            if keep.any():
                onward = np.cumsum(np.concatenate([carried, values[keep][::-1]]), axis=0)
                onward_n = np.cumsum(np.concatenate([carried_n, counts[keep][::-1]]), axis=0)
                carried, carried_n = onward[-1:], onward_n[-1:]
                front = self._write(times[keep], np.ascontiguousarray(onward[:0:-1]), np.ascontiguousarray(onward_n[:0:-1])) + front
        self.numbers |= {"front": front, "back": [], "sums": [0.0] * self.channels, "counts": [0] * self.channels}

    def _front(self, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the front's readings behind each of the rising times `lower`; what is passed leaves."""
        entries = self.numbers["front"]
        while entries and entries[0][2] <= lower[0]:
            del self.parts[entries.pop(0)[0]]
        reached = sum(1 for entry in entries if entry[1] <= lower[-1])
        times, sums, counts = self._read(entries[:reached + 1])
        sums = np.concatenate([sums, np.zeros((1, self.channels))])
        counts = np.concatenate([counts, np.zeros((1, self.channels), np.int64)])
        at = np.searchsorted(times, lower, "right")
        while entries and entries[0][2] <= lower[-1]:
            del self.parts[entries.pop(0)[0]]
        return sums[at], counts[at]

    def push(self, times: np.ndarray, values: np.ndarray, counts: np.ndarray, size_us: int, closed: bool
             ) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts over [t - size, t] (closed) or (t - size, t] for each new reading, in order of time.

        Readings of one time must come in one call. values, counts: by reading and channel, 0 where it is not the channel's.
        """
        lower = times - size_us - closed
        out, n = np.empty_like(values, np.float64), np.empty_like(counts)
        start = 0
        with np.errstate(over="ignore", invalid="ignore"):
            while start < len(times):
                back = self.numbers["back"]
                oldest = back[0][1] if back else int(times[start])
                stop = int(np.searchsorted(lower, oldest, "left"))
                if stop <= start:
                    self._flip(int(lower[start]))
                    continue
                here = slice(start, stop)
                sums = np.cumsum(np.concatenate([[self.numbers["sums"]], values[here]]), axis=0)
                running = np.cumsum(np.concatenate([[self.numbers["counts"]], counts[here]]), axis=0)
                upto = np.searchsorted(times[here], times[here], "right")
                before, before_n = self._front(lower[here])
                out[here], n[here] = before + sums[upto], before_n + running[upto]
                self.numbers["back"] += self._write(times[here], values[here].astype(np.float64), counts[here])
                self.numbers |= {"sums": sums[-1].tolist(), "counts": running[-1].tolist()}
                start = stop
        return out, n

    def clear(self) -> None:
        for number, _, _ in self.numbers["front"] + self.numbers["back"]:
            del self.parts[number]
        for name in ("front", "back", "sums", "counts"):
            del self.numbers[name]


class OrderedRows(StatefulProcessor):
    """Keeps rows until the watermark has passed them and hands them on in order of time, key by key of a bucket.

    A form has `advance(state, new, watermark_us)`, called for each key with new rows or due to be woken; it yields columns
    to hand on.
    """

    def __init__(self, key: str, columns: list[str]):
        self.key, self.columns = key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("keys", "data binary")
        self.large = handle.getMapState("parts", "owner string, part bigint", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = by_key(columns_of(list(rows), [self.key, *self.columns]), self.key)
        yield from self._batch(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._batch({}, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _batch(self, new: dict[str | None, Columns], watermark_ms: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        timer, records = pickle.loads(bytes(self.bucket.get()[0])) if self.bucket.exists() else (None, {})
        due = [key for key, record in records.items()
               if key not in new and record["wake"] is not None and record["wake"] <= watermark_ms]
        found: list[tuple[str | None, Columns]] = []
        for key in [*new, *due]:
            state = KeyState(key, records.setdefault(key, {}), self.large)
            found += [(key, columns) for columns in self.advance(state, new.get(key), watermark_ms * 1000)]
            if not state.settle():
                del records[key]
        # One timer for the bucket, at the earliest time a key is to be woken.
        wanted = min((record["wake"] for record in records.values() if record["wake"] is not None), default=None)
        timer = None if timer == fired else timer
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if records:
            self.bucket.update((pickle.dumps((wanted, records), pickle.HIGHEST_PROTOCOL),))
        elif self.bucket.exists():
            self.bucket.clear()
        if found:
            rows = together([columns for _, columns in found])
            counts = [len(next(iter(columns.values()))) for _, columns in found]
            yield pd.DataFrame({self.key: np.repeat(np.array([key for key, _ in found], object), counts), **rows})


def by_key(rows: Columns, key: str) -> dict[str | None, Columns]:
    """Rows of each key in the order they came, without the key."""
    numbers, _ = pd.factorize(rows[key])
    order = np.argsort(numbers, kind="stable")
    sorted_rows = taken(rows, order)
    edges = [0, *(np.flatnonzero(np.diff(numbers[order])) + 1).tolist(), len(order)]
    names = sorted_rows.pop(key)
    return {None if pd.isna(names[a]) else names[a]: taken(sorted_rows, slice(a, b)) for a, b in zip(edges, edges[1:]) if a < b}


def run_by_key(rows: DataFrame, key: str, processor: OrderedRows, outputs: list[T.StructField], event_time: str = "") -> DataFrame:
    """Rows of `processor` for the rows of each key: the key, and `outputs`. The key may be of any type and null."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias(BUCKET)
    given = rows.select(bucket, *as_text(rows, [key]), *[F.col(name) for name in rows.columns if name != key])
    schema = T.StructType([T.StructField(key, T.StringType()), *outputs])
    more = {"eventTimeColumnName": event_time} if event_time else {}
    found = given.groupBy(BUCKET).transformWithStateInPandas(processor, schema, "append", "EventTime", **more)
    return found.select(*from_text(rows, [key]), *[field.name for field in outputs])


def as_text(rows: DataFrame, names: list[str]) -> list[Column]:
    """Columns that are only carried along go as text: pandas has no null beside NaN, and no whole numbers with nulls."""
    binary = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.BinaryType)]
    return [(F.base64(name) if name in binary else F.col(name).cast("string")).alias(name) for name in names]


def from_text(rows: DataFrame, names: list[str]) -> list[Column]:
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return [(F.unbase64(name) if isinstance(kinds[name], T.BinaryType) else F.col(name).cast(kinds[name])).alias(name) for name in names]
