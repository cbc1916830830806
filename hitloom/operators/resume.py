"""Continue after the last stored row when a log is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.operators.star import LAST_ROW_FIELDS


def resume_after(records: DataFrame, last: DataFrame, order: str = "line_no") -> DataFrame:
    """Records after the first one that equals ``last``; all of them if there is none.

    ``last`` has one row or none. The anchor is a single value and reaches the filter as a scalar
    subquery. ``order`` may be a struct, such as the position a text source gives.
    """
    same = records.select(order, *LAST_ROW_FIELDS).join(
        F.broadcast(last.select(*LAST_ROW_FIELDS).limit(1)), list(LAST_ROW_FIELDS), "left_semi"
    )
    anchor = same.agg(F.min(order)).scalar()
    return records.filter(anchor.isNull() | (F.col(order) > anchor))
