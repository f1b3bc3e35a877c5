"""Checking names against a closed set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_name(column: str, allowed: Sequence[str]) -> Column:
    """False for null as well as for unknown names."""
    return F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def split_by_name(rows: DataFrame, column: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows."""
    known = known_name(column, allowed)
    return rows.where(known), rows.where(~known)


def count_by_name(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Accepted and rejected rows per name."""
    known = known_name(column, allowed)
    return rows.groupBy(column).agg(F.count_if(known).alias("n_ok"), F.count_if(~known).alias("n_rejected"))
