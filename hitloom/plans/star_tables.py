"""The stored star schema: counts, facts and failures by day of each batch, and a record of what is committed.

Every attempt writes to a folder of its own. One record, appended last, names the folder and makes the batch visible: all of
it or nothing. A batch is known by its run and number, so batches of different runs don't meet, and one
that is committed already is skipped when it is replayed. Readers take the list of
committed folders first and read those, without a join.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.operators.counts import count_values
from hitloom.operators.failures import GROUP, day_groups, merged
from hitloom.operators.star import LAST_ROW_FIELDS, checked_dimensions, fact_rows, last_keys, named_last_row, with_keys
from hitloom.schema import BASES, COMMITS, COUNTS, DIMENSIONS, FACT, FAILURES, POSITION


def position(records: DataFrame, order: str) -> Column:
    """A row's place in its batch: a number of an old table or a list, or the place in a log's text."""
    if isinstance(records.schema[order].dataType, T.StructType):
        parts = [F.col(f"{order}.{f.name}").cast(f.dataType).alias(f.name) for f in POSITION.fields]
    else:
        parts = [F.lit(None).cast(f.dataType).alias(f.name) for f in POSITION.fields[:-1]]
        parts.append(F.col(order).cast("bigint").alias(POSITION.fields[-1].name))
    return F.struct(*parts)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the store, without rows if nothing was ever written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, path: str) -> list[T.Row]:
    """The committed batches in order. One short row each: compaction keeps the folders to read few."""
    found = read_table(spark, f"{path}/commits", COMMITS).collect()
    return sorted(found, key=lambda row: (row["number"], row["folder"]))


def is_committed(spark: SparkSession, path: str, run: str, batch_id: int) -> bool:
    same = (F.col("run") == run) & (F.col("batch_id") == batch_id)
    return not read_table(spark, f"{path}/commits", COMMITS).filter(same).isEmpty()


def write_batch(records: DataFrame, path: str, batch_id: int = 0, order: str = "line_no", run: str = "batch") -> bool:
    """Store one batch: its counts per value, its fact rows and its failures by day. False if it was there already.

    Records are worked out once and held on the disks of the executors while the three tables are written; what a lost
    executor held is worked out again. Batches are written one at a time; the number of a commit orders the rows of different batches.
    """
    spark = records.sparkSession
    known = commits(spark, path)
    if any(row["run"] == run and row["batch_id"] == batch_id for row in known):
        return False
    number = known[-1]["number"] + 1 if known else 0
    folder = f"{number:012d}-{uuid.uuid4().hex}"
    placed = records.withColumn("_place", position(records, order)).select("_place", "ts", *DIMENSIONS)
    placed = placed.persist(StorageLevel.DISK_ONLY)
    try:
        # Whole dimensions, and whole days, end up together in files of even size.
        counts = with_keys(count_values(placed)).hint("rebalance", "dim")
        counts.write.partitionBy("dim").parquet(f"{path}/counts/batch={folder}")
        facts = fact_rows(placed, ("_place", "ts")).withColumn("day", F.to_date("ts"))
        facts = facts.withColumnRenamed("_place", "position").drop("ts").hint("rebalance", "day")
        facts.write.partitionBy("day").parquet(f"{path}/fact/commit={folder}")
        failures = day_groups(placed).hint("rebalance", "day")
        failures.write.partitionBy("day").parquet(f"{path}/failures/commit={folder}")
    finally:
        placed.unpersist()
    last = last_keys(_facts_of(spark, path, [folder]), ["position"]).first()
    commit = spark.createDataFrame([(run, batch_id, number, folder, list(last) if last else None)], COMMITS)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return True


def _bases(spark: SparkSession, path: str) -> list[T.Row]:
    return read_table(spark, f"{path}/bases", BASES).collect()


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all committed batches: ``dim, id, value, count``, a value once per batch.

    What is compacted is read from there, once for all its batches. ``dim`` is a folder, so a report on one field
    reads that field only.
    """
    return _counts_of(spark, path, _folders(spark, path))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Where all committed batches are added up: the compacted part, and the batches that it doesn't cover."""
    base = max(_bases(spark, path), key=lambda row: len(row["covers"]), default=None)
    covered = set(base["covers"]) if base else set()
    folders = [base["folder"]] if base else []
    return folders + [row["folder"] for row in commits(spark, path) if row["folder"] not in covered]


def _counts_of(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], COUNTS)
    listed = [f"{path}/counts/batch={folder}" for folder in folders]
    table = spark.read.schema(COUNTS).option("basePath", f"{path}/counts").parquet(*listed)
    return table.select(*COUNTS.names)


def stored_totals(spark: SparkSession, path: str) -> DataFrame:
    """``dim, value, count`` over all committed batches."""
    return stored_counts(spark, path).groupBy("dim", "value").agg(F.sum("count").alias("count"))


def stored_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """``dim, id, value, count`` over all committed batches, checked for clashes."""
    return checked_dimensions(stored_counts(spark, path))


def stored_fact(spark: SparkSession, path: str) -> DataFrame:
    """``position``, the keys, ``commit`` (in the order of commits) and ``day``: folders both."""
    return _facts_of(spark, path, [row["folder"] for row in commits(spark, path)])


def _facts_of(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return _committed(spark, f"{path}/fact", folders, FACT)


def _committed(spark: SparkSession, table: str, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    listed = [f"{table}/commit={folder}" for folder in folders]
    return spark.read.schema(schema).option("basePath", table).parquet(*listed)


def stored_failures(spark: SparkSession, path: str) -> DataFrame:
    """``day, status_code, request_uri_id, count, user_agent``: a group once per batch, or once for all that are compacted.

    ``day`` is a folder, so a window reads its days only.
    """
    found = _committed(spark, f"{path}/failures", _folders(spark, path), FAILURES)
    return found.select(*GROUP, "count", "user_agent")


def stored_last_row(spark: SparkSession, path: str) -> DataFrame:
    """Date, address, method and URI of the last row stored that has all four; no row if none has.

    The record of each batch has the keys of its last such row. So this reads the records, and four dimensions of the newest batch that has
    one: no fact, and no other batch.
    """
    newest = next((row for row in reversed(commits(spark, path)) if row["last"]), None)
    last = list(zip(LAST_ROW_FIELDS, newest["last"])) if newest else []
    counts = _counts_of(spark, path, [newest["folder"]] if newest else [])
    return named_last_row(spark.createDataFrame(last, "dim string, id binary"), counts)


def compact_counts(spark: SparkSession, path: str) -> int:
    """Add up the counts, and the failures by day, of all committed batches for cheaper reports; how many batches they cover.

    The batches stay as they are. The record of the result lists them, so batches committed later, also while this runs, are
    read beside it.
    """
    covers = [row["folder"] for row in commits(spark, path)]
    if not covers:
        return 0
    folder = f"base-{uuid.uuid4().hex}"
    totals = checked_dimensions(_counts_of(spark, path, covers)).hint("rebalance", "dim")
    totals.write.partitionBy("dim").parquet(f"{path}/counts/batch={folder}")
    groups = merged(_committed(spark, f"{path}/failures", covers, FAILURES), *GROUP).hint("rebalance", "day")
    groups.write.partitionBy("day").parquet(f"{path}/failures/commit={folder}")
    spark.createDataFrame([(folder, covers)], BASES).coalesce(1).write.mode("append").parquet(f"{path}/bases")
    return len(covers)
