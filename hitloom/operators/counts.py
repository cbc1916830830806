"""Occurrence counts per value of each field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.schema import DIMENSIONS


def count_values(records: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``dim, value, count`` over all fields in one pass and one shuffle.

    Rejects take part. Empty values are not counted. Hot values collapse to one row per task
    before the shuffle. Name only the needed ``dims``: the others are then not even read.
    """
    pairs = [column for dim in dims for column in (F.lit(dim), F.col(dim))]
    unpivoted = records.select(F.stack(F.lit(len(dims)), *pairs).alias("dim", "value"))
    return (
        unpivoted.filter(F.col("value") != "")
        .groupBy("dim", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def merge_counts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch's counts to the stored ones; values new to the store are inserted."""
    columns = ("dim", "value", "count")
    return (
        stored.select(*columns)
        .unionByName(batch.select(*columns))
        .groupBy("dim", "value")
        .agg(F.sum("count").alias("count"))
    )


def top_values(counts: DataFrame, dim: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of one field; ties go by value."""
    return (
        counts.filter(F.col("dim") == dim)
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(n)
        .select("value", "count")
    )
