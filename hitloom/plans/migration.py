"""From the older flat table to records that enter the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.lines import log_date, timestamp
from hitloom.functions.numbers import leading_integer
from hitloom.functions.once import computed_once
from hitloom.operators.records import MIGRATION_ASSET_SUFFIXES
from hitloom.schema import DIMENSIONS, LEGACY_COLUMNS
from hitloom.sources.legacy import dated_rows


def total_rows(legacy: DataFrame) -> DataFrame:
    return legacy.agg(F.count(F.lit(1)).alias("total"))


def migrate(legacy: DataFrame) -> DataFrame:
    """Dated rows as records with the eleven fields; other columns are kept.

    A row with a garbled method goes whole into ``non_default``, before assets are looked at. An
    empty method becomes ``Invalid``. Static assets are dropped. A row with a bad date goes into
    ``non_default`` too. URI, referrer and agent are copied as they are.
    """
    rows = dated_rows(legacy)
    extra = [name for name in rows.columns if name not in LEGACY_COLUMNS]
    method = F.col("httpMethod")
    garbled = F.contains(method, F.lit("\\")) | F.contains(method, F.lit("{"))
    is_asset = F.lit(False)
    for suffix in MIGRATION_ASSET_SUFFIXES:
        is_asset = is_asset | F.col("requestURI").endswith(suffix)
    rows = rows.filter(garbled | ~is_asset)

    rows = rows.select("*", F.when(~garbled, log_date(F.col("date"))).alias("iso"))
    rows = computed_once(rows, rows.columns, ts=timestamp(F.col("iso")))
    good = F.col("ts").isNotNull()

    def field(column: Column) -> Column:
        return F.when(good, column).otherwise(F.lit(""))

    whole_row = F.to_json(F.struct(*LEGACY_COLUMNS))
    return rows.select(
        *extra,
        field(F.col("iso")).alias("date"),
        field(F.col("remoteIP")).alias("remote_ip"),
        field(F.when(method == "", F.lit("Invalid")).otherwise(method)).alias("http_method"),
        field(F.col("requestURI")).alias("request_uri"),
        field(F.col("statusCode")).alias("status_code"),
        field(F.col("responseSize")).alias("response_size"),
        field(F.col("referrer")).alias("referrer"),
        field(F.col("userAgent")).alias("user_agent"),
        F.when(good, F.lit("")).otherwise(whole_row).alias("non_default"),
        field(F.col("remoteUser")).alias("remote_user"),
        field(F.col("authenticatedUser")).alias("authenticated_user"),
        F.col("ts"),
        F.when(good, leading_integer(F.col("statusCode"))).alias("status_int"),
        F.when(good, F.col("responseSize").try_cast("bigint")).alias("bytes"),
    )


def quarantined(migrated: DataFrame) -> DataFrame:
    extra = [n for n in migrated.columns if n not in (*DIMENSIONS, "ts", "status_int", "bytes")]
    return migrated.filter(F.col("non_default") != "").select(*extra, "non_default")
