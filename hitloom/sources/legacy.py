"""The older flat table: ten text columns, dates still in log form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.schema import LEGACY, LEGACY_COLUMNS


def read_legacy(
    spark: SparkSession, path: str | None = None, source_format: str = "parquet", order: str | None = None, **options: str
) -> DataFrame:
    """Read a dump of the older table with its declared schema, or the table itself without a path.

    ``order`` names a column that numbers the rows, if there is one. The table itself is for sources such as ``jdbc``, which bring their own schema; give them the options
    that split the read.
    """
    reader = spark.read.format(source_format).options(**options)
    numbers = [T.StructField(order, T.LongType())] if order else []
    if path is not None:
        return reader.schema(T.StructType(numbers + LEGACY.fields)).load(path)
    numbers = [F.col(field.name).cast(field.dataType) for field in numbers]
    return reader.load().select(*numbers, *[F.col(name).cast("string") for name in LEGACY_COLUMNS])


def dated_rows(legacy: DataFrame) -> DataFrame:
    """Rows that have a date; NULL texts become empty. The filter reaches the scan."""
    extra = [name for name in legacy.columns if name not in LEGACY_COLUMNS]
    dated = legacy.filter(F.col("date").isNotNull() & (F.col("date") != ""))
    texts = [F.coalesce(F.col(name), F.lit("")).alias(name) for name in LEGACY_COLUMNS]
    return dated.select(*extra, *texts)
