"""Half-open intervals ``[low, end)`` of ordered values, and the points inside them, by ranges of rows.

Rows are cut into ranges by sampled bounds and stored, so that ranges stay the same when a task runs again. Each range is
passed once in order; what it needs to know of the ranges before it is one row of theirs. Keys come first in
the order, so a key with most of the rows is spread over as many ranges as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.neighbors import with_neighbors


def _ranged(df: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    df.repartitionByRange(*order).withColumn("_slot", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _key(keys: Sequence[str]) -> Column:
    # A constant stands for no keys at all.
    return F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_one"))


def _carried(ranged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How far the intervals of each key come in each range of rows; and for each range the last key before it that has
    intervals, with how far those have come. The second is one row for each range."""
    by_key = ranged.groupBy("_slot", "_key").agg(F.max("_end").alias("_far"))
    with_intervals = F.when(F.col("_far").isNotNull(), F.col("_key"))
    lasts = by_key.groupBy("_slot").agg(F.max_by(F.struct("_key", "_far"), with_intervals).alias("_last"))
    far = F.max("_last._far").over(Window.partitionBy("_last._key").orderBy("_slot"))
    lasts = lasts.withColumn("_last", F.when(F.col("_last").isNotNull(), F.struct("_last._key", far.alias("_far"))))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return by_key, lasts.select("_slot", F.last("_last", ignorenulls=True).over(before).alias("_carry"))


def _with_reach(ranged: DataFrame, edges: DataFrame, order: Sequence[str], last: int) -> DataFrame:
    """Append ``_reach``: how far the intervals of a row's key have come, up to the ``last`` row before or the row itself."""
    rows = Window.partitionBy("_slot", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    inside = ranged.withColumn("_inside", F.max("_end").over(rows)).join(F.broadcast(edges), "_slot")
    carried = F.when(F.col("_carry._key").eqNullSafe(F.col("_key")), F.col("_carry._far"))
    return inside.withColumn("_reach", F.greatest("_inside", carried)).drop("_inside", "_carry")


def merge_intervals(intervals: DataFrame, keys: Sequence[str], path: str, low: str = "low", end: str = "end") -> DataFrame:
    """``keys``, ``low``, ``end``: the fewest intervals with the same points. Nested, overlapping and touching ones become one.

    NULL is a key value like others. Empty intervals, and those without a low or an end, count for nothing. An empty table gives no
    rows. ``path``, shared by all executors, takes two tables.
    """
    columns = [F.col(f"`{k}`") for k in keys]
    wanted = intervals.select(*columns, F.col(f"`{low}`").alias("_low"), F.col(f"`{end}`").alias("_end")).filter("_low < _end")
    # Bounds between ranges can't part equal rows, and one of them says as much as all.
    wanted = wanted.distinct()
    ranged = _ranged(wanted, (*keys, "_low", "_end"), f"{path}/intervals").withColumn("_key", _key(keys))
    by_key, edges = _carried(ranged)
    starts = _with_reach(ranged, edges, ("_low", "_end"), -1).filter("_reach is null or _low > _reach")
    # An interval ends where those before the next start had come; behind the last start of a key, where all of them end.
    near = with_neighbors(starts.select(*keys, "_low", "_key", "_reach"), (*keys, "_low"), ("_key", "_reach"), f"{path}/starts")
    furthest = by_key.groupBy("_key").agg(F.max("_far").alias("_far")).withColumnRenamed("_key", "_of")
    closed = near.withColumn("_closed", F.when(F.col("after._key").eqNullSafe(F.col("_key")), F.col("after._reach")))
    inner = closed.filter("_closed is not null").select(*columns, "_low", "_closed")
    last = closed.filter("_closed is null").join(furthest, F.col("_key") == F.col("_of")).select(*columns, "_low", F.col("_far").alias("_closed"))
    return inner.unionByName(last).select(*columns, F.col("_low").alias(low), F.col("_closed").alias(end))


def points_inside(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, path: str, low: str = "low", end: str = "end"
) -> DataFrame:
    """The rows of ``points`` whose ``point`` lies in an interval of the same ``keys``: those that intervals begun before them reach beyond.

    Intervals may overlap, be empty or lack a low or an end, which makes them count for nothing. NULL is a key value like others; a NULL
    point lies nowhere. Repeated rows stay. ``path``, shared by all executors, takes a table.
    """
    columns = [F.col(f"`{k}`") for k in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    asked = points.select(*columns, F.col(f"`{point}`").alias("_at"), F.lit(1).alias("_kind"), row.alias("_row")).filter("_at is not null")
    given = intervals.select(*columns, F.col(f"`{low}`").alias("_at"), F.lit(0).alias("_kind"), F.col(f"`{end}`").alias("_end"))
    # As above, equal intervals count once. Other rows at one point are told apart by a hash.
    given = given.filter("_at < _end").distinct().withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    both = asked.withColumn("_end", F.lit(None).cast(given.schema["_end"].dataType)).unionByName(given)
    # Maps have no hash.
    told = [F.col(f"_row.`{c}`") for c, kind in points.dtypes if "map<" not in kind]
    both = both.withColumn("_tie", F.xxhash64("_end", *told))
    ranged = _ranged(both, (*keys, "_at", "_kind", "_tie"), path).withColumn("_key", _key(keys))
    _, edges = _carried(ranged)
    reached = _with_reach(ranged, edges, ("_at", "_kind"), 0)
    return reached.filter("_kind = 1 and _at < _reach").select("_row.*")
