"""Tables of many files, rejected lines, SQL joins that leave the session's views alone."""

from __future__ import annotations

from compare import difference

from driftwatch.functions.timegrid import DAY_US
from driftwatch.operators import joins
from driftwatch.plans.oracles import ORACLES
from driftwatch.plans.queries import QUERIES
from driftwatch.sources.readings import events, fixture_readings, parse_json_readings, rejected_json_readings


def test_stream_reads_a_folder_of_files(spark, sf_dir, tmp_path):
    events(spark, sf_dir).repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["stream_motor_alerts_ci"](spark, str(tmp_path))
    assert difference(rows, ORACLES["stream_motor_alerts_ci"], sf_dir) is None


def test_incomplete_lines_are_rejected(spark):
    good = '{"ts":"2024-01-01T00:00:00Z","reading":1.5,"sensor_id":4}'
    bad = ['{"ts":"2024-01-01T00:00:00Z","sensor_id":4}', "no json", None]
    lines = spark.createDataFrame([(line,) for line in [good, *bad]], "value string")
    assert [row.reading for row in parse_json_readings(lines).collect()] == [1.5]
    assert rejected_json_readings(lines).count() == 3


def test_sql_form_keeps_the_callers_view(spark, sf_dir):
    spark.range(3).createOrReplaceTempView("readings")
    joins.motor_records_sql(fixture_readings(spark, sf_dir), DAY_US).count()
    assert spark.table("readings").count() == 3
