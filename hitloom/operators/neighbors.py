"""Neighbouring rows in one order over a whole table, without sorting a key, or the table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbors(
    df: DataFrame, order: Sequence[str], carried: Sequence[str], path: str, before: str = "before", after: str = "after"
) -> DataFrame:
    """Append the structs ``before`` and ``after``: the ``carried`` columns of the rows next in ``order``.

    The table is cut into ranges of rows by sampled bounds and stored at ``path``, which all executors
    share, so that the ranges stay the same when a task runs again. Windows cover one range each. The first and last rows
    of a range find their neighbours through a window over two rows per range; ranges are as many as
    partitions. NULLs come first. Ties should be broken by the last columns of ``order``.
    """
    df.repartitionByRange(*order).withColumn("_slot", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    inside = Window.partitionBy("_slot").orderBy(*order)
    value = F.struct(*[F.col(f"`{c}`") for c in carried])
    place = F.struct(*[F.col(f"`{c}`") for c in order])
    marked = ranged.select(
        "*", F.lag(value).over(inside).alias("_before"), F.lead(value).over(inside).alias("_after")
    )
    ends = ranged.groupBy("_slot").agg(F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    across = Window.orderBy("_slot")
    edges = ends.select(
        "_slot", F.lag("_last").over(across).alias("_edge_before"), F.lead("_first").over(across).alias("_edge_after")
    )
    # One row per range, so the broadcast is bounded by the number of partitions.
    joined = marked.join(F.broadcast(edges), "_slot")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce("_before", "_edge_before").alias(before),
        F.coalesce("_after", "_edge_after").alias(after),
    )


def with_neighbor(
    df: DataFrame, key: str, moment: str, value: str, output: str, path: str, following: bool = False
) -> DataFrame:
    """Append ``output``: the ``value`` of the previous (or following) row of the same ``key``.

    Rows are ordered within a key by ``moment`` and then ``value``. A NULL key is a key like others,
    and a NULL moment comes before all. A key that owns most of the rows is cut into as many ranges as its rows need.
    """
    named = df.select("*", F.col(key).alias("_k"), F.col(moment).alias("_m"), F.col(value).alias("_v"))
    near = with_neighbors(named, ("_k", "_m", "_v"), ("_k", "_v"), path, "_before", "_after")
    side = "_after" if following else "_before"
    same: Column = F.col(side).isNotNull() & F.col(f"{side}._k").eqNullSafe(F.col("_k"))
    return near.select(*df.columns, F.when(same, F.col(f"{side}._v")).alias(output))
