"""Properties that hold for any input."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions.rules import ThresholdRule, first_failure
from driftwatch.functions.timegrid import DAY_US
from driftwatch.operators import windows
from driftwatch.operators.liveness import live_readings, sensor_liveness
from driftwatch.sources.readings import fan_in, fixture_readings


def averages(readings):
    motors = windows.motor_windows(readings, DAY_US).select(
        "motor_id", "window", *[F.round(c, 9) for c in ("air", "torque")], *windows.COUNTS, "max_ts"
    )
    return sorted(map(str, motors.collect()))


def test_order_and_shards_do_not_matter(spark, sf_dir):
    readings = fixture_readings(spark, sf_dir)
    whole = averages(readings)
    assert averages(readings.repartition(7).sortWithinPartitions(F.desc("ts"))) == whole
    shards = [readings.where(F.pmod("event_id", F.lit(3)) == k) for k in range(3)]
    assert averages(fan_in(shards)) == whole


def test_sliding_forms_agree(spark, sf_dir):
    readings = fixture_readings(spark, sf_dir)
    for size, slide in ((2 * DAY_US, DAY_US), (3 * DAY_US, 2 * DAY_US), (DAY_US, DAY_US), (DAY_US, 2 * DAY_US)):
        if slide > size:
            # Windows that leave gaps exist only in the pane form.
            direct = windows.sensor_windows(readings.where(F.pmod(F.col("ts_us"), F.lit(slide)) < size), slide)
            columns = ["sensor_id", "window.start", "n", "max_ts"]
        else:
            direct, columns = windows.sensor_windows(readings, size, slide), ["sensor_id", "window", "n", "max_ts"]
        panes = windows.sensor_sliding_windows(readings, size, slide)
        assert sorted(map(str, panes.select(*columns).collect())) == sorted(map(str, direct.select(*columns).collect()))


def test_sweep_equals_single_sizes(spark, sf_dir):
    readings = fixture_readings(spark, sf_dir)
    sizes = [2 * DAY_US, 3 * DAY_US, 6 * DAY_US]
    swept = windows.window_sweep(readings, sizes)
    for size in sizes:
        single = windows.confidence_alerts(windows.motor_windows(readings, size))
        part = swept.where(F.col("size_us") == size).select("motor_id", "window", "ts", "failure")
        assert sorted(map(str, part.collect())) == sorted(map(str, single.collect()))


def test_one_failure_per_row(spark):
    grid = spark.range(6 ** 4).select(*[
        (F.call_function("div", F.pmod("id", F.lit(6 ** (k + 1))), F.lit(6 ** k).cast("bigint")) * step + low).alias(name)
        for k, (name, low, step) in enumerate((("d", 5.0, 1.5), ("s", 1300.0, 40.0), ("p", 2000.0, 1500.0), ("q", 0.0, 4000.0)))
    ])
    conditions = ThresholdRule().conditions(*[F.col(c) for c in grid.columns])
    held = sum((F.coalesce(c, F.lit(False)).cast("int") for _, c in conditions), F.lit(0))
    failures = grid.select(first_failure(conditions).alias("failure"), held.alias("held"))
    assert failures.where((F.col("held") > 0) != F.col("failure").isNotNull()).count() == 0
    assert failures.where("held > 1").count() > 0


def test_live_readings_match_the_report(spark, sf_dir):
    readings = fixture_readings(spark, sf_dir)
    live = {r.sensor_id: r.n for r in live_readings(readings, 2 * DAY_US).groupBy("sensor_id").agg(F.count("*").alias("n")).collect()}
    assert live == {r.sensor_id: r.kept for r in sensor_liveness(readings, 2 * DAY_US).collect()}
