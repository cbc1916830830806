"""Left lookups that hold up when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot if it holds this share of all rows or more, so there are at most 2,000 hot keys
# and the part that is broadcast has a fixed bound, whatever the data.
HOT_SHARE = 1 / 2_000


def skew_proof_lookup(
    rows: DataFrame,
    row_key: str,
    lookup: DataFrame,
    key: str,
    value: str,
    weight: str,
    output: str,
    spread_by: Sequence[str],
) -> DataFrame:
    """Append ``output``: the ``value`` that ``lookup`` holds for each row's key, else NULL.

    ``key`` must be unique in ``lookup``, and ``weight`` be the number of rows that carry it; list
    keys without an answer too, with a NULL ``value``, as they may be hot. Hot keys are looked up in
    a broadcast of at most ``1 / HOT_SHARE`` rows. Only rows with other keys meet the rest of the
    lookup in a shuffle; the settled rows and those without a key are spread evenly by a hash of
    ``spread_by`` instead of piling up on one key. A value may be long (a URI, an agent), so the
    broadcast is bounded by rows and by the length that the caller's values can have.
    """
    total = lookup.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) >= total * F.lit(HOT_SHARE)
    hot = lookup.filter(is_hot).select(
        F.col(key).alias("_hot_key"), F.col(value).alias("_hot_value"), F.lit(True).alias("_hot")
    )
    rest = lookup.filter(~is_hot & F.col(value).isNotNull()).select(
        F.col(key).alias("_rest_key"), F.col(value).alias("_rest_value"), F.lit(True).alias("_wanted")
    )

    row_key_column: Column = F.col(f"`{row_key}`")
    settled = rows.join(F.broadcast(hot), row_key_column == F.col("_hot_key"), "left")
    is_open = row_key_column.isNotNull() & F.col("_hot").isNull()
    spread = F.xxhash64(*[F.col(f"`{name}`") for name in spread_by])
    key_type = rows.schema[row_key].dataType
    spread = F.unhex(F.hex(spread)) if isinstance(key_type, T.BinaryType) else spread.cast(key_type)
    routed = settled.withColumn("_open", is_open).withColumn(
        "_route", F.when(is_open, row_key_column).otherwise(spread)
    )
    on = (F.col("_route") == F.col("_rest_key")) & (F.col("_open") == F.col("_wanted"))
    joined = routed.join(rest, on, "left")
    found = F.when(F.col("_hot"), F.col("_hot_value")).otherwise(F.col("_rest_value"))
    return joined.select(*[F.col(f"`{name}`") for name in rows.columns], found.alias(output))
