"""Trusted address ranges: landed API responses and proxy config text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.addresses import family, with_cidr_parts
from hitloom.functions.once import computed_once
from hitloom.operators.lookups import skew_proof_lookup
from hitloom.schema import RANGE_RESPONSE

# Fixed value: how the etag line of a config file starts.
ETAG_PREFIX = "# Last etag: "


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed API responses: ``source, fetched_at, body``, one file each.

    Files lie in folders ``source=.../fetched_at=...``.
    """
    declared = "body string, source string, fetched_at timestamp_ntz"
    return spark.read.schema(declared).text(path, wholetext=True).select("source", "fetched_at", "body")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Lines of config files: ``file, line_no, value``, numbered from 1.

    A config file is read whole in one task, which keeps its lines in order. A last empty line is not one.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n$", "").alias("value")
    )
    lines = F.posexplode(F.split("value", r"\r?\n"))
    return files.select("file", lines.alias("_at", "value")).select("file", (F.col("_at") + 1).cast("bigint").alias("line_no"), "value")


def valid_snapshots(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses that report success and hold both lists, with ``etag`` and the lists as columns."""
    kept = [name for name in responses.columns if name != body]
    parsed = computed_once(responses, kept, reply=F.from_json(F.col(body), RANGE_RESPONSE))
    result = F.col("reply.result")
    return parsed.filter(
        F.col("reply.success")
        & result["ipv4_cidrs"].isNotNull()
        & result["ipv6_cidrs"].isNotNull()
    ).select(
        *kept,
        F.coalesce(result["etag"], F.lit("")).alias("etag"),
        result["ipv4_cidrs"].alias("ipv4_cidrs"),
        result["ipv6_cidrs"].alias("ipv6_cidrs"),
    )


def snapshot_ranges(snapshots: DataFrame) -> DataFrame:
    """One row per range of each valid snapshot, with its ``family``."""
    kept = [name for name in snapshots.columns if name not in ("ipv4_cidrs", "ipv6_cidrs")]
    listed = snapshots.select(*kept, F.explode(F.concat("ipv4_cidrs", "ipv6_cidrs")).alias("cidr"))
    return listed.select(*kept, family(F.col("cidr")).alias("family"), "cidr")


def config_etags(config_lines: DataFrame) -> DataFrame:
    """``file, etag, lines``: the text after the prefix on the first line that has it, else NULL."""
    marked = F.col("value").startswith(ETAG_PREFIX)
    files = config_lines.groupBy("file").agg(
        F.min_by("value", F.when(marked, F.col("line_no"))).alias("value"),
        F.count(F.lit(1)).alias("lines"),
    )
    return files.select(
        "file", F.split_part("value", F.lit(ETAG_PREFIX), F.lit(2)).alias("etag"), "lines"
    )


def config_ranges(config_lines: DataFrame, letter_start: bool = False) -> DataFrame:
    """Ranges of config files: ``file, line_no, etag, family, cidr``.

    A range line has exactly two tokens, the second starting with a digit; this loses IPv6 ranges
    that start with a letter, unless ``letter_start`` accepts them. An address without a length is
    kept as it is and stands for itself. Lines whose range holds no valid address are left out.
    """
    tokens = F.split("value", " ")
    second = F.get(tokens, F.lit(1))
    start = "^[0-9a-fA-F]" if letter_start else "^[0-9]"
    ranges = config_lines.filter((F.size(tokens) == 2) & second.rlike(start)).select(
        "file", "line_no", F.replace(second, F.lit(";"), F.lit("")).alias("cidr")
    )
    valid = with_cidr_parts(ranges).filter(F.col("net_bits").isNotNull())
    tagged = skew_proof_lookup(
        valid, "file", config_etags(config_lines), "file", "etag", "lines", "etag", ["line_no", "cidr"]
    )
    return tagged.select("file", "line_no", F.coalesce("etag", F.lit("")).alias("etag"), "family", "cidr")
