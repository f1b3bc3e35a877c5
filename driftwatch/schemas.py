"""Explicit schemas of every source. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Channel order inside a motor, the two low bits of a sensor id.
CHANNELS = ("air", "process", "speed", "torque")

# Failure names an alert may carry.
TOOL_WEAR = "ToolWearFailure"
HEAT_DISSIPATION = "HeatDissipationFailure"
POWER = "PowerFailure"
OVERSTRAIN = "OverstrainFailure"
RANDOM = "RandomFailure"
FAILURES = (TOOL_WEAR, HEAT_DISSIPATION, POWER, OVERSTRAIN, RANDOM)

# Processing models a measured run may name.
BASELINE_MODEL = "ObjectOriented"
CANDIDATE_MODEL = "ReactiveStreaming"
MODELS = (CANDIDATE_MODEL, "ClientServer", "SpringQL", BASELINE_MODEL)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


READING_JSON = _struct(("ts", T.StringType()), ("reading", T.FloatType()), ("sensor_id", T.LongType()))

EVENTS = _struct(
    ("event_id", T.LongType()),
    ("ts", T.TimestampNTZType()),
    ("user_id", T.LongType()),
    ("event_type", T.StringType()),
    ("value", T.DoubleType()),
    ("props", T.StringType()),
)

ALERT = _struct(("motor_id", T.LongType()), ("time", T.DoubleType()), ("failure", T.StringType()))
ALERT_WITH_DELAY = T.StructType([*ALERT.fields, T.StructField("delay", T.DoubleType(), True)])

RUN_METRICS = _struct(
    ("id", T.LongType()),
    ("utime", T.LongType()),
    ("stime", T.LongType()),
    ("cutime", T.LongType()),
    ("cstime", T.LongType()),
    ("vmhwm", T.LongType()),
    ("vmpeak", T.LongType()),
    ("load_average", T.FloatType()),
)
