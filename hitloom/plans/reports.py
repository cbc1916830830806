"""The ranked reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.operators.counts import count_values, top_values
from hitloom.operators.failures import failed_requests, leading_failures
from hitloom.operators.star import top_failures
from hitloom.plans.star_tables import stored_counts, stored_failures, stored_totals

DEFAULT_N = 3
WINDOW_DAYS = 30

# Into how many parts the values of a field are dealt before they are ranked together.
RANK_PARTS = 64

# The reports that rank the values of one field.
FIELD_REPORTS = {
    "top_ips": "remote_ip",
    "top_uris": "request_uri",
    "top_referrers": "referrer",
    "top_non_defaults": "non_default",
}


def window_start(as_of: date | str | None = None) -> Column:
    """First day of the 30 days before ``as_of``, default today in UTC; midnight of that day counts."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    day = F.to_date(now if as_of is None else F.lit(str(as_of)))
    return F.date_sub(day, WINDOW_DAYS)


def _ranked_failures(groups: DataFrame, n: int) -> DataFrame:
    ordered = groups.orderBy(
        F.desc("count"), F.asc("request_uri"), F.asc("status_code")
    ).limit(n)
    text = F.concat("request_uri", F.lit(" with user agent "), "user_agent")
    return ordered.select(text.alias("value"), "count")


def failure_groups(records: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Unsuccessful GETs of the last 30 days by status and URI, with the least user agent."""
    recent = failed_requests(records).filter(F.col("ts") >= window_start(as_of).cast("timestamp_ntz"))
    return recent.groupBy("status_code", "request_uri").agg(
        F.count(F.lit(1)).alias("count"), F.min("user_agent").alias("user_agent")
    )


def top_unsuccessful(records: DataFrame, n: int = DEFAULT_N, as_of: date | str | None = None) -> DataFrame:
    """The most frequent failures, straight from the records. Status splits groups but is not shown."""
    return _ranked_failures(failure_groups(records, as_of), n)


def top_unsuccessful_stored(
    fact: DataFrame, counts: DataFrame, n: int = DEFAULT_N, as_of: date | str | None = None
) -> DataFrame:
    """The same answer from the stored star schema."""
    return _ranked_failures(top_failures(fact, counts, window_start(as_of), n), n)


def top_unsuccessful_by_day(
    groups: DataFrame, counts: DataFrame, n: int = DEFAULT_N, as_of: date | str | None = None
) -> DataFrame:
    """The same answer from the stored failures by day: 30 days of them are added up, and no fact is read."""
    return _ranked_failures(leading_failures(groups, counts, window_start(as_of), n), n)


def _field_report(name: str) -> Callable[..., DataFrame]:
    dim = FIELD_REPORTS[name]

    def build(records: DataFrame, n: int, as_of: date | str | None = None) -> DataFrame:
        return top_values(count_values(records, [dim]), dim, n)

    return build


REPORTS: dict[str, Callable[..., DataFrame]] = {
    **{name: _field_report(name) for name in FIELD_REPORTS},
    "top_unsuccessful": top_unsuccessful,
}


def _checked(name: str, n: int) -> None:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; known: {', '.join(REPORTS)}")
    if n < 1:
        raise ValueError("a report needs n >= 1")


def ranked(report: DataFrame) -> DataFrame:
    """Number the rows of a finished report from 1. Only its ``n`` rows reach the window."""
    order = Window.orderBy(F.desc("count"), F.asc("value"))
    return report.select(F.row_number().over(order).alias("rank"), "value", "count")


def run_report(
    records: DataFrame, name: str, n: int = DEFAULT_N, as_of: date | str | None = None
) -> DataFrame:
    """One report by name: ``rank, value, count``."""
    _checked(name, n)
    return ranked(REPORTS[name](records, n, as_of))


def stored_report(
    spark: SparkSession, path: str, name: str, n: int = DEFAULT_N, as_of: date | str | None = None
) -> DataFrame:
    """One report by name from stored star tables. A field report reads the folder of its field only."""
    _checked(name, n)
    if name in FIELD_REPORTS:
        report = top_values(stored_totals(spark, path), FIELD_REPORTS[name], n)
    else:
        report = top_unsuccessful_by_day(stored_failures(spark, path), stored_counts(spark, path), n, as_of)
    return ranked(report)


def run_all_reports(records: DataFrame, n: int = DEFAULT_N, as_of: date | str | None = None) -> DataFrame:
    """All five: ``report, rank, value, count``. The four field reports share one counting pass.

    Ranks are taken twice: in parts of each field by a hash of the value, and then over the parts' first ``n``. So no
    task sorts all values of a field, whatever ``n`` is.
    """
    _checked("top_ips", n)
    names = [pair for name, dim in FIELD_REPORTS.items() for pair in (F.lit(dim), F.lit(name))]
    ordered = (F.desc("count"), F.asc("value"))
    in_part, order = Window.partitionBy("dim", "_part").orderBy(*ordered), Window.partitionBy("dim").orderBy(*ordered)
    fields = (
        count_values(records, list(FIELD_REPORTS.values()))
        .withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(RANK_PARTS)))
        .withColumn("_rank", F.row_number().over(in_part))
        .filter(F.col("_rank") <= n)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(F.create_map(*names)[F.col("dim")].alias("report"), "rank", "value", "count")
    )
    failures = run_report(records, "top_unsuccessful", n, as_of)
    return fields.unionByName(failures.select(F.lit("top_unsuccessful").alias("report"), "*"))
