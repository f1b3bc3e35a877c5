"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Keyed state outside the JVM heap, with changes written per batch instead of whole snapshots.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, name: str = "driftwatch") -> SparkSession:
    """A single-machine session for tests and the benchmark. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    return builder.config(map=STATE_SETTINGS).getOrCreate()


def use_durable_state(spark: SparkSession) -> None:
    """Settings the stateful streams need, for sessions made elsewhere."""
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)


def pin_utc(spark: SparkSession) -> None:
    """Readings carry UTC instants, so bucket edges and casts must not follow a local zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the cluster's own setting first.

    A machine-local folder is chosen only for a local master: on a cluster the blocks must outlive
    the executor that wrote them.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="driftwatch-checkpoint-")
    context.setCheckpointDir(configured)
    return configured
