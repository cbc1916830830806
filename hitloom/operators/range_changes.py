"""Changes in sets of trusted ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.addresses import blocks_of, cidr_text, interval_of, with_cidr_parts
from hitloom.operators.intervals import merge_intervals
from hitloom.operators.neighbors import with_neighbor


def _counted(current: DataFrame, new: DataFrame) -> DataFrame:
    """How often each range occurs on either side; one shuffle, summed before it, and no join."""
    columns = ("source", "family", "cidr")
    sides = current.select(*columns, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new.select(*columns, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    return sides.groupBy(*columns).agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))


def sets_changed(current: DataFrame, new: DataFrame) -> DataFrame:
    """``source, family, changed``: do the two sides hold different ranges, repeats included?"""
    return (
        _counted(current, new)
        .groupBy("source", "family")
        .agg(F.bool_or(F.col("_old") != F.col("_new")).alias("changed"))
    )


def set_differences(current: DataFrame, new: DataFrame) -> DataFrame:
    """``source, family, cidr, change`` for ranges that only one side has."""
    flags = _counted(current, new).filter((F.col("_old") > 0) != (F.col("_new") > 0))
    change = F.when(F.col("_new") > 0, "added").otherwise("removed").alias("change")
    return flags.select("source", "family", "cidr", change)


def etag_changes(snapshots: DataFrame, path: str) -> DataFrame:
    """Snapshots whose etag differs from the one before: ``source, fetched_at, etag, previous_etag``.

    Copies of a snapshot count once. The first snapshot is compared with an empty etag. A NULL source is
    a source, and snapshots without a time come first. ``path`` takes a table.
    """
    slim = snapshots.select("source", "fetched_at", "etag").distinct()
    known = with_neighbor(slim, "source", "fetched_at", "etag", "previous_etag", path)
    previous = F.coalesce("previous_etag", F.lit(""))
    return known.withColumn("previous_etag", previous).filter(F.col("etag") != previous)


def snapshot_differences(snapshots: DataFrame, path: str) -> DataFrame:
    """``source, fetched_at, family, cidr, change``: ranges added or removed by each snapshot of a
    source against the one before.

    Each snapshot is one row with its ranges as an array; the row before brings its array along, and
    only differences are exploded. Copies of a snapshot, and snapshots of one source and time, count as one. A snapshot with
    empty lists still follows and precedes others; a NULL source or time is a value like others. ``path`` takes a table.
    """

    def listed(column: str, family: int) -> Column:
        return F.transform(
            F.filter(column, lambda c: c.isNotNull()), lambda c: F.struct(F.lit(family).alias("family"), c.alias("cidr"))
        )

    whole = snapshots.select("source", "fetched_at", F.concat(listed("ipv4_cidrs", 32), listed("ipv6_cidrs", 128)).alias("_r"))
    moments = whole.groupBy("source", "fetched_at").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_r")))).alias("_ranges")
    )
    known = with_neighbor(moments, "source", "fetched_at", "_ranges", "_earlier", path)
    earlier = F.coalesce("_earlier", F.array().cast(moments.schema["_ranges"].dataType))

    def marked(ranges: Column, change: str) -> Column:
        return F.transform(ranges, lambda r: F.struct(r["family"].alias("family"), r["cidr"].alias("cidr"), F.lit(change).alias("change")))

    changes = F.concat(
        marked(F.array_except("_ranges", earlier), "added"), marked(F.array_except(earlier, F.col("_ranges")), "removed")
    )
    return known.select("source", "fetched_at", F.inline(changes))


def minimal_cover(ranges: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """``keys``, ``family``, ``len``, ``net_bits``, ``cidr``: for each of ``keys``, the fewest ranges with the same addresses.

    Ranges inside others go, and siblings become their parent, at all levels at once: ranges are merged to disjoint
    intervals, each of which falls into its fewest prefixes. Invalid ranges count for nothing, and a NULL key is a key like others. A range
    that is listed many times is read once. ``path`` takes tables.
    """
    named = ranges.select(*[F.col(f"`{k}`") for k in keys], F.col("cidr").alias("_cidr")).distinct()
    parts = with_cidr_parts(named, "_cidr").filter("net_bits is not null")
    low, end = interval_of(F.col("net_bits"), F.col("family"))
    merged = merge_intervals(parts.select(*keys, "family", low.alias("low"), end.alias("end")), [*keys, "family"], path)
    blocks = merged.select(*keys, "family", F.explode(blocks_of(F.col("low"), F.col("end"), F.col("family"))).alias("net_bits"))
    return blocks.select(
        *keys, "family", F.length("net_bits").alias("len"), "net_bits", cidr_text(F.col("net_bits"), F.col("family")).alias("cidr")
    )
