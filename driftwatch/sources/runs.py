"""Measured runs: metric files, delay series, alert logs and the parameters in their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch import schemas
from driftwatch.operators.comparison import number_runs
from driftwatch.operators.ranking import numbered

# Order of the parameters in a result file's name.
PARAMETERS = ("motor_groups", "duration_s", "window_ms", "slide_ms", "sensor_ms", "threads")
AXES = ("y_outer", "x_outer", "x_inner")


def name_parameters(file_name: Column) -> dict[str, Column]:
    """Parameters, model and data set encoded in a result file name.

    The integers are taken in order wherever they stand; the model is the seventh part. Parts that
    are missing or malformed become null.
    """
    parts = F.split(file_name, "_")
    integers = F.filter(F.transform(parts, lambda p: p.try_cast("bigint")), lambda v: v.isNotNull())
    columns = {name: F.try_element_at(integers, F.lit(i + 1)) for i, name in enumerate(PARAMETERS)}
    model = F.try_element_at(parts, F.lit(7))
    columns["model"] = F.when(model.isin(*schemas.MODELS), model)
    columns["dataset"] = F.regexp_extract(F.element_at(parts, -1), r"^([a-z]+)\.csv$", 1)
    return columns


def axis_values(axes: list[str]) -> dict[str, Column]:
    """Name up to three parameters as result axes, innermost first. Missing axes are 0."""
    named = dict(zip(reversed(AXES), axes))
    return {axis: F.col(named[axis]) if axis in named else F.lit(0).cast("bigint") for axis in AXES}


def _origin() -> list[Column]:
    """Where a row was read: `line` increases inside a block, and blocks follow each other in the file."""
    return [
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line"),
    ]


def number_file_rows(rows: DataFrame) -> DataFrame:
    """`run_no` is the place of a sample in its file, so that samples pair as written."""
    order = F.struct(*[name for name in ("line", "position") if name in rows.columns])
    return numbered(
        rows.withColumn("_order", order), ["file_name"], "_order", F.col("block_start"), "run_no"
    ).drop("_order", "block_start", "line")


def run_metrics_files(spark: SparkSession, folder: str, marker: str = "ru") -> DataFrame:
    """Metric rows of every result file with the marker, with the parameters of its name."""
    rows = (
        spark.read.schema(schemas.RUN_METRICS)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("pathGlobFilter", f"*_{marker}.csv")
        .csv(folder)
        .select("*", *_origin())
    )
    return rows.withColumns(name_parameters(F.col("file_name")))


def delay_series_files(spark: SparkSession, folder: str, marker: str = "ad") -> DataFrame:
    """Delay samples: lines of comma-joined numbers, empty parts ignored."""
    lines = spark.read.option("pathGlobFilter", f"*_{marker}.csv").text(folder).select(*_origin(), "value")
    parts = lines.select(
        "file_name", "block_start", "line", F.posexplode(F.split("value", ",")).alias("position", "token")
    )
    samples = parts.where(F.trim("token") != "").select(
        "file_name", "block_start", "line", "position", F.trim("token").cast("double").alias("delay")
    )
    return samples.withColumns(name_parameters(F.col("file_name")))


def alert_log(spark: SparkSession, folder: str, with_delay: bool = True) -> DataFrame:
    """Alert rows from a log; without delay the fourth column is not read."""
    log = spark.read.schema(schemas.ALERT_WITH_DELAY).option("mode", "PERMISSIVE").csv(folder)
    return log if with_delay else log.select(*schemas.ALERT.fieldNames())


def runs_from_events(events: DataFrame) -> DataFrame:
    """View events as measured runs: four types stand for the four models, any other is a model of its own name."""
    # Motor groups of the measured configurations.
    groups = F.array(*[F.lit(v).cast("bigint") for v in (1, 2, 4, 8, 16, 24)])
    model = F.col("event_type")
    for event_type, name in zip(("view", "purchase", "signup", "click"), schemas.MODELS):
        model = F.when(F.col("event_type") == event_type, name).otherwise(model)
    window = F.element_at(
        F.array(*[F.lit(1 << i).cast("bigint") for i in range(13)]), (F.pmod("user_id", F.lit(13)) + 1).cast("int")
    )
    return events.select(
        "event_id",
        model.alias("model"),
        F.element_at(groups, (F.pmod("user_id", F.lit(6)) + 1).cast("int")).alias("motor_groups"),
        window.alias("window_ms"),
        F.floor(F.col("value") * 100.0).alias("utime"),
        F.col("user_id").alias("stime"),
        F.floor(F.col("value") * 50.0).alias("cutime"),
        F.pmod("event_id", F.lit(97)).alias("cstime"),
        (F.lit(10000) + F.floor(F.col("value") * 10.0)).alias("vmhwm"),
        (F.col("value") / 100.0).cast("float").alias("load_average"),
        (F.col("value") / 1000.0).alias("delay"),
    )


def numbered_runs_from_events(events: DataFrame) -> DataFrame:
    return number_runs(runs_from_events(events), ["model", "motor_groups", "window_ms"])
