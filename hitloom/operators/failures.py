"""Unsuccessful requests as partial groups by day, which add up over batches and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.numbers import unsuccessful
from hitloom.operators.star import held_small, value_key

GROUP = ("day", "status_code", "request_uri_id")


def failed_requests(records: DataFrame, method: str = "GET") -> DataFrame:
    """Dated unsuccessful requests that have a URI and a user agent."""
    return records.filter(
        (F.col("http_method") == method)
        & F.col("ts").isNotNull()
        & unsuccessful(F.col("status_code"))
        & (F.col("request_uri") != "")
        & (F.col("user_agent") != "")
    )


def day_groups(records: DataFrame) -> DataFrame:
    """``day, status_code, request_uri_id, count, user_agent``: failures of a day, and the least of their agents.

    A sum and a least text, so groups of batches and of days can be merged in any order and any number of times. Hot URIs collapse to one
    row per task and day before the shuffle. The texts of URIs stay in their dimension.
    """
    keyed = failed_requests(records).select(
        F.to_date("ts").alias("day"), "status_code", value_key(F.col("request_uri")).alias("request_uri_id"), "user_agent"
    )
    return keyed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("count"), F.min("user_agent").alias("user_agent"))


def merged(groups: DataFrame, *by: str) -> DataFrame:
    """Groups that may occur several times, added up by ``by``."""
    return groups.groupBy(*by).agg(F.sum("count").alias("count"), F.min("user_agent").alias("user_agent"))


def leading_failures(groups: DataFrame, counts: DataFrame, since: Column, n: int) -> DataFrame:
    """``status_code, request_uri, user_agent, count`` of the groups since a day that reach the ``n``-th count, ties included.

    Groups of older days lie in other folders and aren't read. URIs are fetched for the leading groups only:
    their keys are broadcast if they are small. ``counts`` may list a value more than once.
    """
    totals = merged(groups.filter(F.col("day") >= since), "status_code", "request_uri_id")
    least = totals.select("count").orderBy(F.desc("count")).limit(n).agg(F.min("count")).scalar()
    leading = totals.filter(F.col("count") >= least)
    wanted = held_small(leading.select("request_uri_id").distinct(), [])
    uris = counts.filter(F.col("dim") == "request_uri").select(F.col("id").alias("request_uri_id"), F.col("value").alias("request_uri"))
    named = uris.join(wanted, "request_uri_id").distinct()
    return leading.join(named, "request_uri_id").select("status_code", "request_uri", "user_agent", "count")
