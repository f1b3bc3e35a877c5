"""Files in, files out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.timegrid import SECOND_US
from driftwatch.operators import comparison, quantiles, windows
from driftwatch.operators.validation import split_by_name
from driftwatch.plans.queries import START_US
from driftwatch.schemas import FAILURES
from driftwatch.sinks.alerts import append_alert_log
from driftwatch.sinks.runs import append_delay_series, append_runs, write_summary
from driftwatch.sources.readings import (
    events,
    fixture_readings,
    format_json_readings,
    json_readings,
    value_file_readings,
)
from driftwatch.sources.runs import (
    alert_log,
    axis_values,
    delay_series_files,
    name_parameters,
    number_file_rows,
    run_metrics_files,
)

HEADER = "id,utime,stime,cutime,cstime,vmhwm,vmpeak,load_average\n"
NAME = "{motors}_60_{window}_{window}_1_400_{model}_{kind}.csv"


def test_json_round_trip(spark, sf_dir, tmp_path):
    written = fixture_readings(spark, sf_dir).limit(50)
    format_json_readings(written).write.text(str(tmp_path / "json"))
    columns = ["sensor_id", F.date_trunc("millisecond", "ts").alias("ts"), "reading"]
    back = json_readings(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, back.select(*columns).collect())) == sorted(map(tuple, written.select(*columns).collect()))


def test_json_junk_is_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ts": "2024-01-01T00:00:01.500Z", "reading": 1.5, "sensor_id": 7}\nnot json\n')
    row = json_readings(spark, str(tmp_path)).collect()
    assert [(r.sensor_id, r.motor_id, r.channel, r.ts_us, r.reading) for r in row] == [
        (7, 1, 3, START_US + 1_500_000, 1.5)
    ]


def test_value_files(spark, tmp_path):
    (tmp_path / "0.txt").write_text("300.5\n301\n\nbroken\n")
    (tmp_path / "3.txt").write_text("40.25\n")
    (tmp_path / "notes.txt").write_text("1\n")
    rows = sorted((r.channel, r.reading) for r in value_file_readings(spark, str(tmp_path)).collect())
    assert rows == [(0, 300.5), (0, 301.0), (3, 40.25)]


def test_alert_log(spark, tmp_path):
    alerts = spark.createDataFrame([(3, "2024-01-01 00:00:01.5", "PowerFailure", 0.25)],
                                   "motor_id long, ts string, failure string, delay double")
    append_alert_log(alerts.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path / "log"))
    assert [tuple(r) for r in alert_log(spark, str(tmp_path / "log")).collect()] == [
        (3, START_US / SECOND_US + 1.5, "PowerFailure", 0.25)
    ]
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "a.csv").write_text("1,2.5,HeatDissipationFailure\n")
    assert tuple(alert_log(spark, str(tmp_path / "short"), with_delay=False).first()) == (1, 2.5, "HeatDissipationFailure")
    assert alert_log(spark, str(tmp_path / "short")).first().delay is None


@pytest.fixture()
def run_folder(tmp_path):
    for model, shift in (("ObjectOriented", 0), ("ReactiveStreaming", 5)):
        metrics = tmp_path / NAME.format(motors=4, window=16, model=model, kind="ru")
        metrics.write_text(HEADER + "".join(f"{i},{10 + i + shift},1,2,3,{100 + i},200,0.5\n" for i in range(4)))
        delays = tmp_path / NAME.format(motors=4, window=16, model=model, kind="ad")
        delays.write_text("0.5,,1.5,\n2.5,\n")
    (tmp_path / "other.csv").write_text("ignored\n")
    return str(tmp_path)


def test_run_metrics_files(spark, run_folder):
    runs = number_file_rows(run_metrics_files(spark, run_folder))
    rows = runs.where("model = 'ReactiveStreaming'").orderBy("run_no").collect()
    assert [r.utime for r in rows] == [15, 16, 17, 18]
    assert {(r.motor_groups, r.window_ms, r.threads, r.dataset) for r in rows} == {(4, 16, 400, "ru")}


def test_delay_series(spark, run_folder):
    series = number_file_rows(delay_series_files(spark, run_folder)).where("model = 'ObjectOriented'")
    assert [(r.run_no, r.delay) for r in series.orderBy("run_no").collect()] == [(1, 0.5), (2, 1.5), (3, 2.5)]


def test_files_to_verdict(spark, run_folder, tmp_path):
    runs = comparison.run_metrics(number_file_rows(run_metrics_files(spark, run_folder)))
    differences = comparison.paired_differences(runs, metrics=["cpu_time", "peak_memory"])
    found = {r.metric: r.verdict for r in comparison.verdicts(comparison.paired_t_test(differences)).collect()}
    assert found == {"cpu_time": "baseline better", "peak_memory": "equal"}

    axes = axis_values(["window_ms", "motor_groups"])
    samples = comparison.long_metrics(runs.withColumns(axes), [*axes, "model"], ["cpu_time"])
    summary = quantiles.five_number_summary(samples, ["metric", *axes, "model"])
    write_summary(summary, str(tmp_path / "summary"))
    back = spark.read.option("header", True).csv(str(tmp_path / "summary")).where("model = 'ObjectOriented'").first()
    assert (back.x_inner, back.x_outer, back.y_outer, float(back.median)) == ("16", 4, 0, 17.5)


def test_append_runs(spark, run_folder, tmp_path):
    runs = run_metrics_files(spark, run_folder).select(
        "id", "utime", "motor_groups", "duration_s", "window_ms", "slide_ms", "sensor_ms", "threads", "model")
    for _ in range(2):
        append_runs(runs, str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results")).count() == 16


def test_repeated_appends(spark, run_folder, tmp_path):
    """An append made again takes its own place; another one adds rows, also to the same folders."""
    runs = run_metrics_files(spark, run_folder).select(
        "id", "utime", "motor_groups", "duration_s", "window_ms", "slide_ms", "sensor_ms", "threads", "model")
    folder, back = str(tmp_path / "results"), lambda: spark.read.option("header", True).csv(str(tmp_path / "results"))
    for append_id in ("a", "a", "b", "a"):
        append_runs(runs, folder, append_id)
    assert back().count() == 2 * runs.count() and back().groupBy("append_id").count().collect()[0]["count"] == runs.count()
    append_runs(runs.limit(1), folder, "a")  # what it held in other folders is another parameter set's
    assert set(back().columns) == {*runs.columns, "append_id"}


def test_delay_lines(spark, tmp_path):
    delays = spark.createDataFrame([(0.25,), (1.5,)], "delay double")
    append_delay_series(delays, str(tmp_path / "delays"))
    lines = spark.read.text(str(tmp_path / "delays")).collect()
    assert sorted(r.value for r in lines) == ["0.25,", "1.5,"]


def test_unknown_names_are_rejected(spark):
    df = spark.createDataFrame([("PowerFailure",), ("Nonsense",), (None,)], "failure string")
    accepted, rejected = split_by_name(df, "failure", FAILURES)
    assert [r.failure for r in accepted.collect()] == ["PowerFailure"]
    assert {r.failure for r in rejected.collect()} == {"Nonsense", None}


def test_malformed_names(spark):
    df = spark.createDataFrame([("x_2_oops_7.csv",), ("1_60_8_8_1_400_Unknown_ru.csv",)], "n string")
    rows = df.select(*[c.alias(k) for k, c in name_parameters(F.col("n")).items()]).collect()
    assert (rows[0].motor_groups, rows[0].duration_s, rows[0].model) == (2, None, None)
    assert (rows[1].window_ms, rows[1].model, rows[1].dataset) == (8, None, "ru")


def test_run_bounds_reach_the_scan(spark, sf_dir):
    bounded = windows.run_bounds(events(spark, sf_dir), START_US, 86_400 * SECOND_US)
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_sweep_grid(spark):
    grid = windows.sweep_grid(spark, [1, 4], [1, 4, 8], [1, 2])
    assert sorted(map(tuple, grid.collect())) == [(1, 1, 1), (4, 1, 1), (4, 1, 2), (4, 4, 1), (4, 4, 2)]
