"""Access-log text, one request per line."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A text file has no line numbers. Lines of all segments are ordered without a shuffle by a struct:
# segments by age and name, blocks of a segment by offset, lines of a block by the order read.
_BLOCK = {
    "segment_time": "_metadata.file_modification_time",
    "segment": "_metadata.file_path",
    "block": "_metadata.file_block_start",
}

# A century: no segment is too old to be read.
NO_AGE_LIMIT = "36525d"


def usable_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Drop one final carriage return per line, then the blank lines."""
    text = F.col(value)
    trimmed = F.when(text.endswith("\r"), F.expr(f"left({value}, length({value}) - 1)"))
    return lines.withColumn(value, F.coalesce(trimmed, text)).filter(F.col(value) != "")


def _with_block(lines: DataFrame) -> DataFrame:
    place = F.struct(*[F.col(column).alias(name) for name, column in _BLOCK.items()])
    return lines.select(place.alias("line_pos"), "value")


def with_sequence(lines: DataFrame) -> DataFrame:
    """Complete ``line_pos`` by the order in which the lines of a block are read.

    For rows that come straight from the source, before any shuffle.
    """
    parts = [F.col(f"line_pos.{name}").alias(name) for name in _BLOCK]
    place = F.struct(*parts, F.monotonically_increasing_id().alias("seq"))
    return lines.withColumn("line_pos", place)


def read_log_lines(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Lines of closed log segments, plain or compressed. ``position`` adds ``line_pos``.

    The line separator is set because the default also splits on a lone carriage return.
    ``line_pos`` is comparable within one read; store it with the rows to keep it.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return usable_lines(with_sequence(_with_block(lines)) if position else lines)


# Above as many blocks, of 128 MB each by default, their counts are joined with the lines instead of being broadcast.
MOST_BROADCAST = 100_000


def read_numbered_lines(spark: SparkSession, path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``segment, line_no, log_line_no, value``: lines with their number in their file, from 1, as all lines count, and in the whole log.

    Segments follow each other by age and name. Blocks are counted first, a row each; the counts are added up in order of the
    blocks, and a line's number is that of its block's first line and its place in the block. Lines themselves aren't
    sorted. Blank lines count and are then dropped. The files must not change meanwhile.
    """
    lines = with_sequence(_with_block(spark.read.option("lineSep", "\n").text(path)))
    block = [F.col(f"line_pos.{name}").alias(name) for name in _BLOCK]
    seq = F.col("line_pos.seq")
    counted = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"))
    before = Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # One row for each segment.
    sizes = counted.groupBy("segment").agg(F.sum("_n").alias("_size"), F.min("segment_time").alias("_time"))
    earlier = Window.orderBy("_time", "segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("segment").alias("_of"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_log_before"))
    placed = placed.join(sizes, F.col("segment") == F.col("_of"))
    places = placed.select(
        F.col("segment").alias("_segment"), F.col("block").alias("_block"), (F.col("_before") - F.col("_first") + 1).alias("_shift"), "_log_before"
    )
    known = places.limit(most_broadcast + 1).collect()
    if len(known) <= most_broadcast:
        places = F.broadcast(spark.createDataFrame(known, places.schema))
    same = (F.col("line_pos.segment") == F.col("_segment")) & (F.col("line_pos.block") == F.col("_block"))
    numbered = usable_lines(lines).join(places, same)
    number = seq + F.col("_shift")
    return numbered.select(
        F.col("line_pos.segment").alias("segment"), number.alias("line_no"), (number + F.col("_log_before")).alias("log_line_no"), "value"
    )


def stream_log_lines(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream over a folder of closed segments.

    A segment is read once, when it appears, however old its time is: rotated logs keep theirs when they
    are moved. Lines added to it later are not seen, so segments must be rotated into the folder. The price is that the
    checkpoint lists every segment ever seen, a short line each; start a new folder and checkpoint when that list grows too long.
    The trigger limit keeps a backlog from becoming a single batch.
    ``line_pos`` names the block; ``with_sequence`` completes it inside a batch.
    """
    lines = (
        spark.readStream.option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("maxFileAge", NO_AGE_LIMIT)
        .text(path)
    )
    return usable_lines(_with_block(lines))


def set_segment_times(spark: SparkSession, path: str, days_back: int) -> None:
    """Give the segments in a folder the time of some days ago, as moved ones have."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moment = int((time.time() - days_back * 86_400) * 1000)
    for status in files.listStatus(folder):
        files.setTimes(status.getPath(), moment, moment)


def land_lines(lines: DataFrame, path: str, value: str = "value", segment: Column | None = None) -> None:
    """Write lines as text segments, one sub-folder per ``segment`` if it is given.

    Lines of a file are in the order of their partition.
    """
    if segment is None:
        lines.select(F.col(value).alias("value")).write.text(path, lineSep="\n")
        return
    (
        lines.select(F.col(value).alias("value"), segment.alias("segment"))
        .write.partitionBy("segment")
        .text(path, lineSep="\n")
    )
