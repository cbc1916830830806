"""Continuous ingest of rotated log segments into the star tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hitloom.operators.records import parse_lines, without_assets
from hitloom.plans.star_tables import write_batch
from hitloom.sources.access_log import stream_log_lines, with_sequence
from hitloom.sources.growing_log import follow_log_lines

DEFAULT_INTERVAL = "10 seconds"


def stream_records(
    spark: SparkSession, segments: str, omit: str = "", max_files_per_trigger: int = 1000
) -> DataFrame:
    """New lines as records without static assets, each with its ``line_pos``."""
    lines = stream_log_lines(spark, segments, max_files_per_trigger)
    return without_assets(parse_lines(lines, omit=omit))


def follow_records(spark: SparkSession, logs: str, omit: str = "") -> DataFrame:
    """The same for lines that are appended to logs, which needn't be closed."""
    return without_assets(parse_lines(follow_log_lines(spark, logs), omit=omit))


def triggered(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def start_record_stream(
    records: DataFrame, path: str, checkpoint: str, interval: str | None = DEFAULT_INTERVAL
) -> StreamingQuery:
    """Append records to Parquet. ``interval`` None takes what is there and ends."""
    writer = records.writeStream.format("parquet").option("path", path)
    return triggered(writer.option("checkpointLocation", checkpoint), interval).start()


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that ``checkpoint`` belongs to, kept beside its own files. A new checkpoint is a new run."""
    path = f"{checkpoint}/run"
    try:
        return spark.read.text(path).first()["value"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    run = uuid.uuid4().hex
    spark.createDataFrame([(run,)], "value string").coalesce(1).write.text(path)
    return run


def start_star_stream(
    records: DataFrame, path: str, checkpoint: str, interval: str | None = DEFAULT_INTERVAL
) -> StreamingQuery:
    """Keep the star tables up to date, one committed batch per trigger.

    No counts are held in stream state: each batch stores its own, and totals are their sum. The
    checkpoint remembers which segments are done, so restarts neither skip nor repeat lines. Batches are numbered within the
    run of this checkpoint: several runs, and batches stored by other jobs, can share one folder, and a
    batch that is replayed after its commit is skipped.
    """
    run = run_of(records.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(with_sequence(batch), path, batch_id, order="line_pos", run=run)

    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()
