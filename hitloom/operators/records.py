"""Log lines to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.lines import (
    TOKENS,
    line_tokens,
    normalize_referrer,
    normalize_uri,
    timestamp,
    token_date,
    without_quotes,
)
from hitloom.functions.numbers import leading_integer
from hitloom.functions.once import computed_once
from hitloom.schema import DIMENSIONS

# Static assets that are not counted; the migration leaves out one more.
ASSET_SUFFIXES = (".woff2", ".js", ".css")
MIGRATION_ASSET_SUFFIXES = (".woff2", ".js", ".xml", ".css")


def parse_lines(
    lines: DataFrame,
    value: str = "value",
    omit: str = "",
    trailing_only: bool = False,
    strict: bool = False,
    raw_uri: str | None = None,
) -> DataFrame:
    """Parse each line into the eleven text fields plus ``ts``, ``status_int`` and ``bytes``.

    Other columns of ``lines`` are kept. A line with too few tokens goes whole into
    ``non_default``; so does one with a bad date, which keeps its ``remote_ip``. Absent is the
    empty string. ``strict`` also rejects lines whose status is not three digits. ``raw_uri`` names one more
    column, for the URI before its slashes are stripped.
    """
    kept = [name for name in lines.columns if name != value]
    line = F.col(value)
    tokens = F.col("_tokens")

    def token(i: int) -> Column:
        return F.get(tokens, F.lit(i))

    step = lines.select("*", line_tokens(line).alias("_tokens"))
    # Each step names what the next one uses more than once.
    dated = F.size(tokens) == TOKENS
    if strict:
        dated = dated & token(8).rlike("^[0-9]{3}$")
    step = step.select("*", F.when(dated, token(3)).alias("_stamp"))
    step = step.select("*", token_date(F.col("_stamp")).alias("_date"))
    step = step.select("*", timestamp(F.col("_date")).alias("_ts"))
    step = step.select("*", F.when(F.col("_ts").isNotNull(), without_quotes(token(6))).alias("_uri"))
    step = computed_once(
        step,
        (*kept, value),
        tokens=tokens,
        date=F.col("_date"),
        ts=F.col("_ts"),
        uri=normalize_uri(F.col("_uri"), trailing_only),
        **({"raw_uri": F.col("_uri")} if raw_uri else {}),
    )

    tokens = F.col("tokens")
    ts = F.col("ts")

    def field(column: Column) -> Column:
        return F.when(ts.isNotNull(), column).otherwise(F.lit(""))

    has_address = F.size(tokens) == TOKENS
    status = token(8)
    size = token(9)
    empty = F.lit("")
    step = step.select("*", without_quotes(token(10)).alias("referrer"))
    return step.select(
        *kept,
        field(F.col("date")).alias("date"),
        F.when(has_address, token(0)).otherwise(empty).alias("remote_ip"),
        field(without_quotes(token(5))).alias("http_method"),
        field(F.col("uri")).alias("request_uri"),
        field(status).alias("status_code"),
        field(size).alias("response_size"),
        field(normalize_referrer(F.col("referrer"), omit, trailing_only)).alias("referrer"),
        field(without_quotes(token(11))).alias("user_agent"),
        F.when(ts.isNotNull(), empty).otherwise(line).alias("non_default"),
        empty.alias("remote_user"),
        empty.alias("authenticated_user"),
        ts.alias("ts"),
        F.when(ts.isNotNull(), leading_integer(status)).alias("status_int"),
        F.when(ts.isNotNull(), size.try_cast("bigint")).alias("bytes"),
        *([F.col("raw_uri").alias(raw_uri)] if raw_uri else []),
    )


def without_assets(
    records: DataFrame, suffixes: tuple[str, ...] = ASSET_SUFFIXES, uri: str = "request_uri"
) -> DataFrame:
    """Drop requests for static assets. Case-sensitive; a query string hides the suffix."""
    is_asset = F.lit(False)
    for suffix in suffixes:
        is_asset = is_asset | F.col(uri).endswith(suffix)
    return records.filter(~is_asset)


def parsed_only(records: DataFrame) -> DataFrame:
    return records.filter(F.col("non_default") == "")


def rejects(records: DataFrame) -> DataFrame:
    """Lines that did not parse, with the address if it was read before the date failed."""
    kept = [name for name in records.columns if name not in (*DIMENSIONS, "ts", "status_int", "bytes")]
    return records.filter(F.col("non_default") != "").select(*kept, "remote_ip", "non_default")
