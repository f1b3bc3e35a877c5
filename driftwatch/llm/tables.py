"""Intermediate tables and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.session import ensure_checkpoint_dir

# Rows of a few dozen bytes each, so that a broadcast stays within some tens of megabytes.
BROADCAST_ROWS = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder shared by all executors and read it back.

    Later steps then start from files that outlive any executor, and the planner knows their size.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a saved table if a count proves it small; beyond that the planner shuffles both sides."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def text_of(column: str) -> Column:
    """A text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
