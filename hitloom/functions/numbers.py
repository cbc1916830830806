"""Lenient text-to-number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_integer(text: Column) -> Column:
    """The integer at the start of a text, or 0: garbage never raises and is never NULL."""
    digits = F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    zero = F.lit(0).cast("bigint")
    # The plain cast settles nearly all rows without the regular expression.
    return F.coalesce(text.try_cast("bigint"), digits.try_cast("bigint"), zero)


def unsuccessful(status: Column) -> Column:
    return ~leading_integer(status).between(200, 399)
