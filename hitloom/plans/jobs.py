"""Whole jobs on stored tables: follow a log batch by batch, and move an old table into the star."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.operators.records import parse_lines, without_assets
from hitloom.operators.resume import resume_after
from hitloom.plans import migration, star_tables
from hitloom.sources.access_log import read_log_lines


def unstored_records(spark: SparkSession, records: DataFrame, path: str, order: str = "line_pos") -> DataFrame:
    """Records after the last row that the star at ``path`` holds."""
    return resume_after(records, star_tables.stored_last_row(spark, path), order)


def ingest_batch(spark: SparkSession, log: str, path: str, batch_id: int, run: str = "log", omit: str = "") -> bool:
    """Read a log again, and store what follows the last stored row as one batch. False if the batch was there already."""
    if star_tables.is_committed(spark, path, run, batch_id):
        return False
    records = without_assets(parse_lines(read_log_lines(spark, log, position=True), omit=omit))
    return star_tables.write_batch(unstored_records(spark, records, path), path, batch_id, order="line_pos", run=run)


def migrate_table(legacy: DataFrame, path: str, order: str = "row_no", run: str = "migration", batch_id: int = 0) -> bool:
    """Store an older flat table as one batch. ``order`` numbers its rows. False if it was there already."""
    return star_tables.write_batch(migration.migrate(legacy), path, batch_id, order=order, run=run)


CHUNK_ROWS = 20_000_000

# A chunk holds the rows from ``low`` on and below ``end``; the first has no low, and takes rows without a number too, the last has no end.
CHUNKS = T.StructType(
    [
        T.StructField("plan", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)


def _planned_chunks(legacy: DataFrame, path: str, order: str, run: str, chunk_rows: int) -> list[T.Row]:
    """The chunks of a run, planned once and stored beside the star, so that a later call goes on with the same."""
    spark = legacy.sparkSession
    folder = f"{path}/chunks/{run}"
    stored = star_tables.read_table(spark, folder, CHUNKS)
    if stored.isEmpty():
        number = F.col(order).cast("bigint")
        total = legacy.agg(F.count(F.lit(1))).first()[0]
        parts = -(-total // chunk_rows)
        shares = [i / parts for i in range(1, parts)]
        found = legacy.agg(F.percentile_approx(number, F.lit(shares).cast("array<double>"), 100 * parts)).first()[0] if shares else []
        bounds = [None, *sorted(set(found or [])), None]
        plan = uuid.uuid4().hex
        rows = [(plan, i, low, end, total) for i, (low, end) in enumerate(zip(bounds, bounds[1:]))]
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(folder)
        stored = star_tables.read_table(spark, folder, CHUNKS)
    # If two calls planned at once, all take the same of both plans.
    rows = stored.collect()
    chosen = min(row["plan"] for row in rows)
    return sorted((row for row in rows if row["plan"] == chosen), key=lambda row: row["batch_id"])


def migrate_in_chunks(
    legacy: DataFrame, path: str, order: str = "row_no", run: str = "migration", chunk_rows: int = CHUNK_ROWS, most_chunks: int | None = None
) -> int:
    """Store an older flat table in chunks of about ``chunk_rows``, a committed batch each; how many are still to do.

    ``order`` numbers the rows. Chunks are ranges of it, cut at quantiles. What is committed is skipped, so after a failure, or after ``most_chunks`` new ones,
    a later call goes on where this one stopped, with the chunks first planned. Rows without a number go with the first chunk, and rows of one number stay together. At the end the
    table must still have as many rows as were planned for; else it changed meanwhile, and that is an error.
    """
    spark = legacy.sparkSession
    chunks = _planned_chunks(legacy, path, order, run, chunk_rows)
    done = {row["batch_id"] for row in star_tables.commits(spark, path) if row["run"] == run}
    left = [chunk for chunk in chunks if chunk["batch_id"] not in done]
    number = F.col(order).cast("bigint")
    for chunk in left[:most_chunks]:
        inside = F.lit(True)
        if chunk["low"] is not None:
            inside = inside & (number >= chunk["low"])
        if chunk["end"] is not None:
            inside = inside & (number < chunk["end"])
        if chunk["low"] is None:
            inside = inside | number.isNull()
        migrate_table(legacy.filter(inside), path, order, run, chunk["batch_id"])
    remaining = 0 if most_chunks is None else max(0, len(left) - most_chunks)
    if not remaining:
        rows = migration.total_rows(legacy).first()["total"]
        if rows != chunks[0]["total"]:
            raise ValueError(f"the table has {rows} rows, but {chunks[0]['total']} were planned for: it changed during its migration")
    return remaining
