"""The checked queries: one per operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.addresses import family, with_cidr_parts
from hitloom.functions.lines import normalize_uri as stripped_uri
from hitloom.operators import counts, failures, range_changes, records, star, trust
from hitloom.plans import jobs, migration, reports, star_tables
from hitloom.schema import DIMENSIONS, FACT_FIELDS
from hitloom.session import scratch_path
from hitloom.sources import access_log, growing_log, legacy, trusted_ranges
from hitloom.streaming import ingest
from hitloom.streaming import ranges as range_stream
from hitloom.workloads import inputs

# The test events end in January 2024; this day makes the 30-day filter keep a part of them.
AS_OF = "2024-02-10"
TOP_N = 10
OMITTED = "self.example"

# Where the stored part ends when the log is taken as two batches.
SECOND_BATCH = "2024-01-20 00:00:00"

NUMBERED_SEGMENTS = 16

RECORD = ("line_no", *DIMENSIONS, "ts", "status_int", "bytes")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log.usable_lines(inputs.log_lines(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return records.parse_lines(_lines(spark, sf_dir), **options)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without_assets(_parsed(spark, sf_dir))


def _stored_star(spark: SparkSession, kept: DataFrame) -> str:
    path = scratch_path(spark, "star")
    star_tables.write_batch(kept, path)
    return path


def _fact_rows(spark: SparkSession, path: str) -> DataFrame:
    facts = star_tables.stored_fact(spark, path).agg(F.count(F.lit(1)).alias("count"))
    return facts.select(F.lit("fact").alias("dim"), F.lit("rows").alias("value"), "count")


def _with_key_texts(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumns({key: star.key_text(F.col(key)) for key in keys})


# Sources, parsing, cleaning


@query
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through real text files: landed, then read with the log source."""
    path = scratch_path(spark, "segments")
    access_log.land_lines(inputs.log_lines(spark, sf_dir), path)
    return access_log.read_log_lines(spark, path)


@query
def numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in order of their lines, read back with numbers that count each segment's lines."""
    path = scratch_path(spark, "segments")
    lines = inputs.log_lines(spark, sf_dir).withColumn("segment", F.col("line_no") % NUMBERED_SEGMENTS)
    ordered = lines.repartition("segment").sortWithinPartitions("segment", "line_no")
    ordered.select("segment", "value").write.partitionBy("segment").text(path, lineSep="\n")
    numbered = access_log.read_numbered_lines(spark, f"{path}/*")
    segment = F.regexp_extract("segment", "/segment=([0-9]+)/", 1).cast("bigint")
    return numbered.select(segment.alias("segment"), "line_no", "value")


@query
def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(*RECORD)


@query
def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, strict=True).select(*RECORD)


@query
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rejects(_parsed(spark, sf_dir))


@query
def filter_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("line_no", "http_method", "request_uri", "non_default")


@query
def normalize_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to strip slashes, from one parse."""
    parsed = records.parsed_only(_parsed(spark, sf_dir, raw_uri="_raw"))
    trailing = F.coalesce(stripped_uri(F.col("_raw"), True), F.lit(""))
    return parsed.select("line_no", "request_uri", trailing.alias("trailing_only_uri"))


@query
def normalize_referrer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parsed_only(_parsed(spark, sf_dir)).select("line_no", "referrer")


@query
def omit_referrer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parsed_only(_parsed(spark, sf_dir, omit=OMITTED)).select("line_no", "referrer")


# Counts and reports


@query
def dim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_values(_kept(spark, sf_dir))


@query
def dim_counts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as two batches by time, counted apart and merged."""
    kept = _kept(spark, sf_dir)
    later = F.coalesce(F.col("ts") >= F.lit(SECOND_BATCH).cast("timestamp_ntz"), F.lit(False))
    return counts.merge_counts(
        counts.count_values(kept.filter(~later)), counts.count_values(kept.filter(later))
    )


def _field_report(name: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.REPORTS[name](_kept(spark, sf_dir), TOP_N)

    return build


for _name in reports.FIELD_REPORTS:
    QUERIES[_name] = _field_report(_name)


@query
def top_unsuccessful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_unsuccessful(_kept(spark, sf_dir), TOP_N, AS_OF)


@query
def unsuccessful_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group behind the report, before the top is taken."""
    return reports.failure_groups(_kept(spark, sf_dir), AS_OF)


@query
def report_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_all_reports(_kept(spark, sf_dir), TOP_N, AS_OF)


# Star schema


@query
def star_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_key_texts(star.checked_dimensions(counts.count_values(_kept(spark, sf_dir))), "id")


@query
def star_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_key_texts(star.fact_rows(_kept(spark, sf_dir)), *[f"{name}_id" for name in FACT_FIELDS])


def _read_back(spark: SparkSession, path: str, small: int | None = None) -> DataFrame:
    fact = star_tables.stored_fact(spark, path)
    back = star.read_back(fact, star_tables.stored_dimensions(spark, path), small=small)
    return back.select(F.col("position.seq").alias("line_no"), *FACT_FIELDS)


@query
def star_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as star tables, read, and joined back to texts."""
    return _read_back(spark, _stored_star(spark, _kept(spark, sf_dir)))


@query
def star_roundtrip_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every dimension too large to broadcast."""
    return _read_back(spark, _stored_star(spark, _kept(spark, sf_dir)), small=0)


@query
def star_migrate_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table and a streamed log in one star: totals of both, and the number of facts."""
    path = scratch_path(spark, "star")
    jobs.migrate_table(_legacy(spark, sf_dir), path)
    incoming = ingest.stream_records(spark, f"{_landed(spark, sf_dir)}/*", max_files_per_trigger=_files_per_trigger(spark))
    ingest.start_star_stream(incoming, path, f"{path}-checkpoint", interval=None).awaitTermination()
    return star_tables.stored_totals(spark, path).unionByName(_fact_rows(spark, path))


@query
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.stored_last_row(spark, _stored_star(spark, _kept(spark, sf_dir)))


@query
def top_unsuccessful_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure report again, through stored star tables."""
    path = _stored_star(spark, _kept(spark, sf_dir))
    return reports.top_unsuccessful_stored(
        star_tables.stored_fact(spark, path), star_tables.stored_counts(spark, path), TOP_N, AS_OF
    )


@query
def report_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five reports from stored star tables."""
    return _stored_reports(spark, _stored_star(spark, _kept(spark, sf_dir)))


def _in_three_batches(spark: SparkSession, kept: DataFrame) -> str:
    """Two batches, compacted, and one after them."""
    path = scratch_path(spark, "star")
    part = F.col("line_no") % 3
    for batch in range(2):
        star_tables.write_batch(kept.filter(part == batch), path, batch)
    star_tables.compact_counts(spark, path)
    star_tables.write_batch(kept.filter(part == 2), path, 2)
    return path


@query
def report_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where older batches are compacted and later ones aren't."""
    return _stored_reports(spark, _in_three_batches(spark, _kept(spark, sf_dir)))


@query
def failures_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each day as stored with the batches, added up over compacted and later ones."""
    path = _in_three_batches(spark, _kept(spark, sf_dir))
    groups = failures.merged(star_tables.stored_failures(spark, path), *failures.GROUP)
    uris = star_tables.stored_dimensions(spark, path).filter(F.col("dim") == "request_uri")
    named = groups.join(uris.select(F.col("id").alias("request_uri_id"), F.col("value").alias("request_uri")), "request_uri_id")
    return named.select("day", "status_code", "request_uri", "count", "user_agent")


@query
def last_row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row where the newest batch has no complete one, so that an earlier batch gives it."""
    kept = _kept(spark, sf_dir)
    path = scratch_path(spark, "star")
    odd = F.col("line_no") % 2 == 1
    for batch, part in enumerate((~odd & (F.col("non_default") == ""), odd, ~odd & (F.col("non_default") != ""))):
        star_tables.write_batch(kept.filter(part), path, batch)
    return star_tables.stored_last_row(spark, path)


def _stored_reports(spark: SparkSession, path: str) -> DataFrame:
    tables = [
        reports.stored_report(spark, path, name, TOP_N, AS_OF).select(F.lit(name).alias("report"), "*")
        for name in reports.REPORTS
    ]
    return reduce(DataFrame.unionByName, tables)


@query
def resume_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to a day are stored; the whole log is read again and only what follows is kept."""
    kept = _kept(spark, sf_dir)
    path = _stored_star(spark, kept.filter(F.col("ts") < F.lit(SECOND_BATCH).cast("timestamp_ntz")))
    rest = jobs.unstored_records(spark, kept, path, "line_no")
    return rest.select("line_no", *star.LAST_ROW_FIELDS, "non_default")


QUERIES["resume_after"] = resume_stored


# Migration


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older table, through a dump of it."""
    path = scratch_path(spark, "legacy")
    inputs.legacy_rows(spark, sf_dir).write.parquet(path)
    return legacy.read_legacy(spark, path, order="row_no")


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.migrate(_legacy(spark, sf_dir))


@query
def v1_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.total_rows(_legacy(spark, sf_dir))


@query
def v1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parsed_only(_migrated(spark, sf_dir)).select("row_no", *DIMENSIONS, "ts")


@query
def v1_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.quarantined(_migrated(spark, sf_dir))


@query
def v1_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migrated, stored as star tables, totals read back."""
    path = scratch_path(spark, "star")
    jobs.migrate_table(_legacy(spark, sf_dir), path)
    return star_tables.stored_totals(spark, path)


@query
def v1_star_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in chunks: stopped after two, and gone on with; totals, and the number of facts."""
    path = scratch_path(spark, "star")
    old = _legacy(spark, sf_dir)
    chunk_rows = -(-old.count() // 4)
    jobs.migrate_in_chunks(old, path, chunk_rows=chunk_rows, most_chunks=2)
    jobs.migrate_in_chunks(old, path, chunk_rows=chunk_rows)
    return star_tables.stored_totals(spark, path).unionByName(_fact_rows(spark, path))


# Trusted ranges


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted_ranges.valid_snapshots(inputs.responses(spark, sf_dir))


@query
def cidr_from_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted_ranges.snapshot_ranges(_snapshots(spark, sf_dir))


@query
def cidr_from_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted_ranges.config_ranges(inputs.config_lines(spark, sf_dir))


@query
def cidr_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = trusted_ranges.snapshot_ranges(_snapshots(spark, sf_dir)).drop("family")
    return with_cidr_parts(ranges).select("source", "fetched_at", "cidr", "addr", "len", "family", "net_bits")


def _current_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    current, new = inputs.supplier_ranges(spark, sf_dir), inputs.new_ranges(spark, sf_dir)
    of_family = family(F.col("cidr")).alias("family")
    return current.select("*", of_family), new.select("*", of_family)


@query
def cidr_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_changes.sets_changed(*_current_and_new(spark, sf_dir))


@query
def cidr_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_changes.set_differences(*_current_and_new(spark, sf_dir))


@query
def cidr_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot of a source against the one before."""
    return range_changes.snapshot_differences(_snapshots(spark, sf_dir), scratch_path(spark, "snapshots"))


@query
def etag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_changes.etag_changes(_snapshots(spark, sf_dir), scratch_path(spark, "etags"))


@query
def cidr_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest ranges that hold all that each source has ever published."""
    ranges = trusted_ranges.snapshot_ranges(_snapshots(spark, sf_dir)).select("source", "cidr")
    return range_changes.minimal_cover(ranges, ["source"], scratch_path(spark, "cover"))


# Trust


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines: assets and garbage are requests too."""
    return _parsed(spark, sf_dir).select("line_no", "remote_ip", "bytes")


@query
def trust_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.label_trusted(_requests(spark, sf_dir), inputs.trusted_ranges(spark))


@query
def trust_label_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of any length: joined with the distinct addresses."""
    ranges = inputs.supplier_ranges(spark, sf_dir)
    return trust.label_trusted(_requests(spark, sf_dir), ranges, folder=scratch_path(spark, "addresses"))


@query
def trust_label_short_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ranges that hold a large part of all addresses."""
    ranges = inputs.ranges_with_short_prefixes(spark, sf_dir)
    return trust.label_trusted(_requests(spark, sf_dir), ranges, folder=scratch_path(spark, "addresses"))


@query
def trust_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request against the ranges that its source had published last at its time."""
    through = F.expr(inputs.THROUGH).alias("source")
    requests = _parsed(spark, sf_dir).select("line_no", "remote_ip", "ts", through)
    snapshots = trusted_ranges.valid_snapshots(inputs.responses(spark, sf_dir, inputs.LOG_SNAPSHOT))
    return trust.label_trusted_then(requests, snapshots, scratch_path(spark, "then"))


@query
def trusted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.trusted_requests(_requests(spark, sf_dir), inputs.supplier_ranges(spark, sf_dir))


@query
def untrusted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.untrusted_requests(_requests(spark, sf_dir), inputs.supplier_ranges(spark, sf_dir))


@query
def block_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.block_counters(_requests(spark, sf_dir), inputs.trusted_ranges(spark))


@query
def restore_real_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.restore_addresses(inputs.proxied(spark, sf_dir), inputs.trusted_ranges(spark))


# Streaming


def _files_per_trigger(spark: SparkSession) -> int:
    """Enough files to keep all cores busy, and still more than one batch."""
    return 3 * spark.sparkContext.defaultParallelism


def _landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "segments")
    lines = inputs.log_lines(spark, sf_dir)
    access_log.land_lines(lines, path, segment=F.col("line_no") % 5)
    return path


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments on disk, streamed through the parser into stored records."""
    path = scratch_path(spark, "records")
    segments = f"{_landed(spark, sf_dir)}/*"
    incoming = ingest.stream_records(spark, segments, max_files_per_trigger=_files_per_trigger(spark))
    fields = incoming.select(*DIMENSIONS, "ts", "status_int", "bytes")
    ingest.start_record_stream(fields, path, f"{path}-checkpoint", interval=None).awaitTermination()
    return spark.read.schema(fields.schema).parquet(path)


@query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments on disk, streamed into star tables batch by batch; totals over the batches."""
    path = scratch_path(spark, "star")
    segments = f"{_landed(spark, sf_dir)}/*"
    incoming = ingest.stream_records(spark, segments, max_files_per_trigger=_files_per_trigger(spark))
    ingest.start_star_stream(incoming, path, f"{path}-checkpoint", interval=None).awaitTermination()
    return star_tables.stored_totals(spark, path)


@query
def stream_late_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of which one is landed after a first run, with a time 30 days back; totals over both runs."""
    segments, path = scratch_path(spark, "segments"), scratch_path(spark, "star")
    lines = inputs.log_lines(spark, sf_dir)
    late = F.col("line_no") % 5 == 0
    for folder, part in (("now", ~late), ("late", late)):
        access_log.land_lines(lines.filter(part), f"{segments}/{folder}")
        if folder == "late":
            access_log.set_segment_times(spark, f"{segments}/{folder}", days_back=30)
        incoming = ingest.stream_records(spark, f"{segments}/*", max_files_per_trigger=_files_per_trigger(spark))
        ingest.start_star_stream(incoming, path, f"{path}-checkpoint", interval=None).awaitTermination()
    return star_tables.stored_totals(spark, path)


@query
def stream_growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow between two runs of a stream, one of them renamed meanwhile; totals over both runs."""
    logs, path = scratch_path(spark, "logs"), scratch_path(spark, "star")
    lines = inputs.log_lines(spark, sf_dir)
    later = F.col("line_no") % 3 == 0
    access_log.land_lines(lines.filter(~later), logs)
    for run in range(2):
        if run:
            folder = growing_log.local_path(logs)
            inputs.append_lines(lines.filter(later), folder)
            first = min(name for name in os.listdir(folder) if not name.startswith((".", "_")))
            os.rename(f"{folder}/{first}", f"{folder}/{first}.1")
        incoming = ingest.follow_records(spark, logs)
        ingest.start_star_stream(incoming, path, f"{path}-checkpoint", interval=None).awaitTermination()
    return star_tables.stored_totals(spark, path)


@query
def stream_range_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that land in order of time, in four parts, and one part of them again; changes by a stream that is restarted for each."""
    landed, path = scratch_path(spark, "responses"), scratch_path(spark, "changes")
    responses = inputs.responses(spark, sf_dir)
    year = F.coalesce(F.year("fetched_at"), F.lit(0))
    for low, end in ((0, 1993), (1993, 1995), (0, 1993), (1995, 1997), (1997, 10_000)):
        responses.filter((year >= low) & (year < end)).write.mode("append").parquet(landed)
        incoming = range_stream.stream_responses(spark, landed, _files_per_trigger(spark))
        changes = range_stream.stream_changes(incoming)
        range_stream.start_change_stream(changes, path, f"{path}-checkpoint", interval=None).awaitTermination()
    return spark.read.schema(changes.schema).parquet(path)
