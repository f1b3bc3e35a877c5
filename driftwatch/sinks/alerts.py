"""Alert logs: rows of motor_id, time (epoch seconds), failure, delay (seconds), without header."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwatch.functions.timegrid import epoch_seconds
from driftwatch.schemas import ALERT_WITH_DELAY


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Log columns of alerts that carry `delay`."""
    return alerts.withColumn("time", epoch_seconds(F.unix_micros("ts"))).select(*ALERT_WITH_DELAY.fieldNames())


def arrived_now(alerts: DataFrame) -> DataFrame:
    """Add the delay between an alert and its arrival at the sink."""
    waited = F.unix_micros(F.current_timestamp()) - F.unix_micros("ts")
    return alerts.withColumn("delay", epoch_seconds(waited))


def append_alert_log(alerts: DataFrame, folder: str) -> None:
    alert_rows(alerts).write.mode("append").csv(folder)


def stream_alert_log(alerts: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append each alert once, with its arrival delay."""
    writer = alert_rows(arrived_now(alerts)).writeStream.format("csv").outputMode("append")
    writer = writer.option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def push_alerts(alerts: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str,
                available_now: bool = False) -> StreamingQuery:
    """Hand each micro-batch of alerts to `deliver(batch, batch_id)`.

    A batch may be handed over again after a failure; `batch_id` lets the receiver drop the repeat.
    """
    writer = alerts.writeStream.outputMode("append").foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replace_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A `push_alerts` receiver that keeps one folder per batch, so a repeat replaces itself."""
    def deliver(batch: DataFrame, batch_id: int) -> None:
        alert_rows(arrived_now(batch)).write.mode("overwrite").csv(f"{folder}/batch={batch_id}")

    return deliver
