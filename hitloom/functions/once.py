"""Keep costly expressions from being evaluated more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, kept: Sequence[str], **columns: Column) -> DataFrame:
    """The ``kept`` columns and new ``columns``, each of which is evaluated once per row.

    Filters written above a projection are pushed below it, with a copy of every expression they
    mention. For the line parser that repeats the tokenising several times per row. A one-row
    ``stack`` is a generator, and a filter on generated columns stays above it.
    """
    generated = F.stack(F.lit(1), *columns.values()).alias(*columns)
    return df.select(*[F.col(f"`{name}`") for name in kept], generated)
