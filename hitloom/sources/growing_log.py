"""A stream over log files that grow: lines appended since the last batch, by byte offset.

The folder must be one that the driver and all executors mount, as followed logs lie on file systems that can append. A log is
known by its file number there, not by its name, so a log that is renamed when it rotates goes on where it stood. An
offset holds, for each log, the end of its last whole line and a digest of the bytes before it. Where a log no longer has those bytes
at that place, it was truncated or replaced and starts anew; a file not seen before that does have the bytes of a known log there is a copy of
it, as rotation by copy and truncation makes, and goes on where that log stood.
"""

from __future__ import annotations

import datetime
import glob
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from hitloom.sources.access_log import usable_lines

NAME = "hitloom_growing_log"
SCHEMA = "segment_time timestamp, segment string, block long, value string"

# Bytes that a task reads, that are read at once, and before an end that tell a log from others.
RANGE_BYTES = 64 * 2**20
READ_BYTES = 4 * 2**20
MARK_BYTES = 1024

_ROWS = 20_000


def local_path(path: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", path)


def _mark(path: str, end: int) -> str:
    """A digest of the bytes before ``end``."""
    with open(path, "rb") as file:
        begin = max(0, end - MARK_BYTES)
        file.seek(begin)
        return hashlib.sha256(file.read(end - begin)).hexdigest()[:32]


def _last_line_end(path: str, size: int) -> int:
    """The place behind the last line feed in the first ``size`` bytes; 0 if there is none."""
    with open(path, "rb") as file:
        end = size
        while end > 0:
            begin = max(0, end - READ_BYTES if end < size else end - MARK_BYTES)
            file.seek(begin)
            found = file.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


@dataclass
class LogRange(InputPartition):
    """Bytes of a log; a line belongs to the range that its first byte is in."""

    path: str
    number: str
    begin: int
    end: int
    aligned: bool


def _number(path: str) -> str:
    status = os.stat(path)
    return f"{status.st_dev}:{status.st_ino}"


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, pattern: str, range_bytes: int):
        self.pattern = pattern
        self.range_bytes = range_bytes

    def _files(self) -> list[str]:
        found = f"{self.pattern.rstrip('/')}/*" if os.path.isdir(self.pattern) else self.pattern
        return sorted(p for p in glob.glob(found) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All logs that are there, each up to the end of its last whole line."""
        logs = {}
        for path in self._files():
            try:
                end = _last_line_end(path, os.path.getsize(path))
                if end:
                    logs[_number(path)] = {"path": path, "end": end, "mark": _mark(path, end)}
            except FileNotFoundError:
                # Renamed since it was listed; the next batch finds it under its new name.
                continue
        return logs

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found: list[InputPartition] = []
        for number, log in sorted(end.items()):
            path = _located(log["path"], number)
            begin = self._begin(path, log, start.get(number), start)
            for at in range(begin, log["end"], self.range_bytes):
                found.append(LogRange(path, number, at, min(at + self.range_bytes, log["end"]), at == begin))
        return found

    @staticmethod
    def _begin(path: str, log: dict, known: dict | None, start: dict) -> int:
        def holds(other: dict) -> bool:
            return other["end"] <= log["end"] and _mark(path, other["end"]) == other["mark"]

        if known is not None:
            return known["end"] if holds(known) else 0
        return max((other["end"] for other in start.values() if holds(other)), default=0)

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        path = _located(partition.path, partition.number)
        moment = datetime.datetime.fromtimestamp(int(os.path.getmtime(path)), datetime.timezone.utc)
        places: list[int] = []
        lines: list[str] = []

        def batch() -> pa.RecordBatch:
            n = len(lines)
            arrays = [
                pa.array([moment] * n, pa.timestamp("us", tz="UTC")), pa.array([f"file:{partition.path}"] * n, pa.string()),
                pa.array(places, pa.int64()), pa.array(lines, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["segment_time", "segment", "block", "value"])

        for place, line in _lines(path, partition.begin, partition.end, partition.aligned):
            places.append(place)
            lines.append(line.decode("utf-8", "replace"))
            if len(lines) == _ROWS:
                yield batch()
                places, lines = [], []
        if lines:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


def _located(path: str, number: str) -> str:
    """Where the log lies now, which rotation may have renamed within its folder."""
    if os.path.exists(path) and _number(path) == number:
        return path
    folder = os.path.dirname(path)
    for name in sorted(os.listdir(folder)):
        if _number(f"{folder}/{name}") == number:
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{path} (file {number}) is gone before all of its lines were read")


def _lines(path: str, begin: int, end: int, aligned: bool) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that start in the range; one that starts there is read to its end."""
    with open(path, "rb") as file:
        # A range inside a log starts behind the line feed at or after the byte before it.
        at = begin if aligned else begin - 1
        file.seek(at)
        rest, skipping = [], not aligned
        while at < end or rest:
            data = file.read(READ_BYTES)
            if not data:
                return
            parts = data.split(b"\n")
            place = at
            for number, part in enumerate(parts[:-1]):
                line_place = place - sum(map(len, rest)) if number == 0 else place
                place += len(part) + 1
                if skipping:
                    skipping = False
                elif line_place >= end:
                    return
                else:
                    yield line_place, b"".join([*rest, part]) if number == 0 else part
                if number == 0:
                    rest = []
            at += len(data)
            if parts[-1]:
                rest.append(parts[-1])
            if at - sum(map(len, rest)) >= end:
                return


class GrowingLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(local_path(self.options["path"]), int(self.options.get("rangeBytes", RANGE_BYTES)))


def follow_log_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``line_pos, value``: the lines of all logs in a folder (or of a pattern), and those appended later, each once.

    A last line without a line feed waits until it has one. Blank lines go, bytes that are no UTF-8 become replacement characters, and compressed files
    aren't for this source. What a batch covers is cut into ranges of ``range_bytes``, read by as many tasks. A log that is deleted, or moved out of the folder, before a batch has
    read what was planned makes that batch fail; lines written and removed between two batches are never seen. The checkpoint holds one short record for each
    log in the folder.
    """
    spark.dataSource.register(GrowingLogSource)
    lines = spark.readStream.format(NAME).option("path", path).option("rangeBytes", range_bytes).load()
    return usable_lines(lines.select(F.struct("segment_time", "segment", "block").alias("line_pos"), "value"))
