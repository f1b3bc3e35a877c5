"""Alerts on trailing ranges with repeated readings do not depend on how rows are cut into batches or chunks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from driftwatch.operators import resets
from driftwatch.operators.chunkscan import appended, recent

SECOND = 1_000_000
MOTORS = 400
SIZE, AGE = 6 * SECOND, SECOND


def _motor(draw):
    """(second, channel, value) with many repeats of sensor and time; power is mostly far out of its limits."""
    rows = []
    for _ in range(draw.randrange(4, 40)):
        second, channel = draw.randrange(1, 18), draw.randrange(4)
        value = draw.choice([(300.0, 280.0), (310.0, 311.0), (1.0, 1500.0), (1.0, 40.0)][channel])
        rows += [(second, channel, value + draw.choice([0.0, 0.5]) * (k > 0)) for k in range(draw.choice([1, 1, 2, 3]))]
    return sorted(rows)


@pytest.fixture(scope="module")
def histories():
    draw = random.Random(21)
    return [_motor(draw) for _ in range(MOTORS)]


def _columns(rows):
    ts, channel, x = (np.array(c) for c in zip(*rows))
    ts = ts.astype(np.int64) * SECOND
    return {"position": (ts << 3) | (channel + 1), "ts_us": ts, "channel": channel, "reading": x.astype(float),
            "fresh": np.ones(len(ts), bool)}


@pytest.fixture(scope="module")
def whole(histories):
    """Alerts (motor, time, failure) of each history in one piece."""
    out = []
    for motor, rows in enumerate(histories):
        found = resets.trailing_reset_step(_columns(rows), 0, SIZE, AGE)
        out += [(motor, int(p) >> 3, name) for p, name in zip(found["position"], found["failure"])]
    assert len(out) > MOTORS and len(set(out)) < len(out)
    return sorted(out)


def test_pieces(histories, whole):
    draw, out = random.Random(4), []
    for motor, rows in enumerate(histories):
        columns, last, repeat, history = _columns(rows), 0, 0, None
        cuts = sorted({0, len(rows), *(draw.randrange(len(rows)) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:]):
            seen = appended(history, {name: values[a:b] for name, values in columns.items()})
            found = resets.trailing_reset_step(seen, last, SIZE, AGE, repeat=repeat)
            out += [(motor, int(p) >> 3, name) for p, name in zip(found["position"], found["failure"])]
            if len(found["position"]):
                last, repeat = int(found["position"][-1]), int(found["repeat"][-1])
            history = recent(seen, SIZE)
    assert sorted(out) == whole


@pytest.mark.parametrize("batch_rows, rows_per_task", [(3, 2_000_000), (10_000, 9)])
def test_batches_and_chunks(spark, histories, whole, batch_rows, rows_per_task):
    rows = [(m, c, s * SECOND, x) for m, history in enumerate(histories) for s, c, x in history]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "motor_id bigint, channel bigint, ts_us bigint, reading double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        alerts = resets.alerts_trailing_reset(table, SIZE, 0, AGE, rows_per_task=rows_per_task)
        got = sorted((r.motor_id, r.us, r.failure) for r in alerts.selectExpr("motor_id", "unix_micros(ts) AS us", "failure").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == whole
