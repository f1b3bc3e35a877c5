"""Many keys share a bucket's state: few calls to the store, the same rows, and large keys in parts of their own."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.streaming import DataStreamWriter

from driftwatch.functions.timegrid import SECOND_US
from driftwatch.plans import queries
from driftwatch.streaming import keyed
from driftwatch.streaming.trailing import LiveReadings, TrailingMeans


class Store:
    """A value state, a map state and the timers of one bucket, counting calls."""

    def __init__(self):
        self.value, self.parts, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, clear=lambda: self._put(None),
                               update=self._put)

    def getMapState(self, name, key, value):
        return SimpleNamespace(getValue=lambda k: self._call(self.parts.__getitem__, k),
                               updateValue=lambda k, v: self._call(self.parts.__setitem__, k, v),
                               removeKey=lambda k: self._call(self.parts.pop, k))

    def registerTimer(self, at):
        self._call(self.timers.add, at)

    def deleteTimer(self, at):
        self._call(self.timers.remove, at)

    def _put(self, value):
        self.calls, self.value = self.calls + 1, value

    def _call(self, form, *args):
        self.calls += 1
        return form(*args)


def _drained(processor, batches):
    """Batches of (rows, watermark in ms) through one bucket, with the timers that are due, as Spark would."""
    store, out = Store(), []
    processor.init(store)
    for rows, watermark in batches:
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        if rows:
            frame = pd.DataFrame(rows, columns=["sensor_id", *processor.columns])
            out += processor.handleInputRows((0,), iter([frame]), values)
        for at in sorted(t for t in store.timers if t <= watermark):
            info = SimpleNamespace(getExpiryTimeInMs=lambda: at)
            out += processor.handleExpiredTimer((0,), values, info)
            store.timers.discard(at)
    return pd.concat(out), store


def _batches(keys, count, seed=3):
    draw, batches = random.Random(seed), []
    for k in range(count):
        rows = [(key, SECOND_US * (10 * k + draw.randrange(10)), draw.choice([1.0, 2.5, 4.0]), 1) for key in keys for _ in range(4)]
        batches.append((rows, 1000 * 10 * (k - 1)))
    return batches + [([], 10**9), ([], 2 * 10**9)]


@pytest.mark.parametrize("small", [65_536, 0])
def test_bucket_against_brute_force(monkeypatch, small):
    monkeypatch.setattr(keyed, "SMALL_BYTES", small)
    keys = ["7", "8", None, ""]
    batches = _batches(keys, 6)
    got, store = _drained(TrailingMeans("sensor_id", ["ts_us", "reading", "present"], 15 * SECOND_US, True, 1), batches)
    rows = [row for part, _ in batches for row in part]
    want = []
    for key, ts, x, _ in rows:
        inside = [r[2] for r in rows if r[0] == key and ts - 15 * SECOND_US <= r[1] <= ts]
        want.append((repr(key), ts, x, sum(inside), len(inside)))
    found = [(repr(r.sensor_id), r.ts_us, r.reading, r.sum_0, r.n_0) for r in got.itertuples()]
    assert sorted(found) == sorted(want)
    assert store.value is None and not store.parts and not store.timers


def test_calls_follow_buckets_not_keys():
    def calls(keys):
        form = TrailingMeans("sensor_id", ["ts_us", "reading", "present"], 15 * SECOND_US, True, 1)
        return _drained(form, _batches(keys, 6))[1].calls

    assert calls([str(k) for k in range(300)]) <= 2 * calls(["0"]) <= 60


def test_silent_keys_are_cut_by_one_timer():
    rows = [("a", SECOND_US * k, 1.0) for k in range(5)] + [("b", 0, 1.0), ("b", 90 * SECOND_US, 2.0)]
    got, store = _drained(LiveReadings("sensor_id", ["ts_us", "reading"], 10 * SECOND_US),
                          [(rows, 0), ([], 50_000), ([("a", 95 * SECOND_US, 3.0)], 60_000)])
    assert sorted(zip(got.sensor_id, got.ts_us)) == [("a", SECOND_US * k) for k in range(5)] + [("b", 0)]
    assert not store.timers


def test_slices_are_one_batch_each_however_many_files(spark, sf_dir, tmp_path, monkeypatch):
    """A table of many files gives no more micro-batches than one of a single file."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    rows = queries.stream_throttled_avg(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, queries.throttled_avg(spark, sf_dir).collect()))
    assert len([p for p in started[0].recentProgress if p["numInputRows"]]) <= queries.SLICES + 1


def test_null_motors_share_a_bucket_without_harm(spark, sf_dir, tmp_path, monkeypatch):
    """Positions are whole numbers beyond those of doubles; a null key beside them must not cost digits, nor take others' rows."""
    monkeypatch.setattr(keyed, "BUCKETS", 1)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for folder, user in (("plain", "user_id"), ("nulls", "IF(event_id % 50 = 7, NULL, user_id)")):
        kept = events if folder == "nulls" else events.where("event_id % 50 != 7")
        kept.selectExpr("event_id", "ts", f"{user} AS user_id", "event_type", "value", "props").write.parquet(
            str(tmp_path / folder / "events.parquet"))
    found = lambda name, folder: sorted(map(tuple, getattr(queries, name)(spark, str(tmp_path / folder)).collect()), key=repr)
    assert found("stream_alerts_trailing_reset", "nulls") == found("alerts_trailing_reset", "plain") != []
    means = [row for row in found("stream_sensor_trailing_avg", "nulls") if row[1] is not None]
    assert means == found("sensor_trailing_avg", "plain")
