"""Keeping a table's own columns apart from those that an operator works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "c:"


def own(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` but ``without``, under names that no operator uses."""
    return [F.col(f"`{c}`").alias(_MARK + c) for c in df.columns if c not in without]


def back(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """Those columns of the table ``df`` under their first names."""
    return [F.col(f"`{_MARK}{c}`").alias(c) for c in df.columns if c not in without]
