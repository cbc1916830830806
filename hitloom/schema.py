"""Declared schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The record fields, in storage order.
DIMENSIONS = (
    "date",
    "remote_ip",
    "http_method",
    "request_uri",
    "status_code",
    "response_size",
    "referrer",
    "user_agent",
    "non_default",
    "remote_user",
    "authenticated_user",
)

# An unparsable line is counted, but it has no row in the fact table.
FACT_FIELDS = tuple(name for name in DIMENSIONS if name != "non_default")

# Columns of the older flat table, in order.
LEGACY_COLUMNS = (
    "date",
    "remoteIP",
    "httpMethod",
    "requestURI",
    "statusCode",
    "responseSize",
    "referrer",
    "userAgent",
    "remoteUser",
    "authenticatedUser",
)

LEGACY = T.StructType([T.StructField(name, T.StringType()) for name in LEGACY_COLUMNS])

COUNTS = T.StructType(
    [
        T.StructField("dim", T.StringType()),
        T.StructField("id", T.BinaryType()),
        T.StructField("value", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

# The place of a row in its batch; an old table and a numbered list have a number only.
POSITION = T.StructType(
    [
        T.StructField("segment_time", T.TimestampType()),
        T.StructField("segment", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

FACT = T.StructType(
    [T.StructField("position", POSITION)]
    + [T.StructField(f"{name}_id", T.BinaryType()) for name in FACT_FIELDS]
    + [T.StructField("commit", T.StringType()), T.StructField("day", T.DateType())]
)

# Failures of a day by status and URI, with the least of their agents.
FAILURES = T.StructType(
    [
        T.StructField("status_code", T.StringType()),
        T.StructField("request_uri_id", T.BinaryType()),
        T.StructField("count", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

# ``last`` holds the keys that identify the last complete row of the batch, if it has one.
COMMITS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("number", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("last", T.ArrayType(T.BinaryType())),
    ]
)

# Compacted counts and failures, and the batches that they cover.
BASES = T.StructType(
    [T.StructField("folder", T.StringType()), T.StructField("covers", T.ArrayType(T.StringType()))]
)

RANGE_RESPONSE = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField(
            "result",
            T.StructType(
                [
                    T.StructField("etag", T.StringType()),
                    T.StructField("ipv4_cidrs", T.ArrayType(T.StringType())),
                    T.StructField("ipv6_cidrs", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)
