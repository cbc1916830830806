"""Changes of published ranges as a stream: the last snapshot of each source is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hitloom.sources.trusted_ranges import valid_snapshots
from hitloom.streaming.ingest import DEFAULT_INTERVAL, triggered

RESPONSES = "source string, fetched_at timestamp_ntz, body string"

# Rows that a task takes before it drops repeated ones.
_HELD = 200_000

# Stands for a snapshot without a time, which comes before all others.
_NO_TIME = -(2**63)

_CHANGE = "source string, at long, etag string, previous_etag string, etag_changed boolean, set_changed boolean"
_FOLLOWED = "source string, at long, etag string, digest string, follows boolean, ends boolean, before_at long, before_etag string, set_changed boolean"
_STATE = "at long, etag string, digest string"


def stream_responses(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Landed responses: Parquet files of ``source, fetched_at, body`` that appear in a folder, each read once."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct snapshots of a range of the order, each with the time and etag of the one before it in the range.

    The first of a source in the range has none, and ``ends`` marks the last, so that ranges can be joined to each other.
    """
    order = ["source", "at", "etag"]
    held: list[pa.RecordBatch] = []
    rows, kept = 0, 0

    def single() -> pa.Table:
        # Of several under one time and etag, that with the least digest counts.
        least = pa.Table.from_batches(held).group_by(order, use_threads=False).aggregate([("digest", "min")])
        return least.select([*order, "digest_min"]).rename_columns([*order, "digest"])

    for batch in batches:
        held.append(batch.select([*order, "digest"]))
        rows += batch.num_rows
        if rows > max(_HELD, 2 * kept):
            held = single().to_batches()
            rows = kept = sum(b.num_rows for b in held)
    if not rows:
        return
    table = single().sort_by([(c, "ascending") for c in order]).combine_chunks()
    source, at, etag, digest = [table.column(c).combine_chunks() for c in [*order, "digest"]]
    one = pc.fill_null(pc.equal(source[1:], source[:-1]), False)
    both_null = pc.and_(pc.is_null(source[1:]), pc.is_null(source[:-1]))
    follows = pa.concat_arrays([pa.array([False]), pc.or_(one, both_null)])
    ends = pa.concat_arrays([pc.invert(follows[1:]), pa.array([True])])
    before = [pa.concat_arrays([column[:1], column[:-1]]) for column in (at, etag, digest)]
    columns = [source, at, etag, digest, follows, ends, before[0], before[1], pc.not_equal(digest, before[2])]
    yield from pa.Table.from_arrays(columns, names=[name.split()[0] for name in _FOLLOWED.split(", ")]).to_batches(max_chunksize=10_000)


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The new snapshots of one source, each against the one before. They come in any order and pass by; only the ends of ranges are held."""
    known = tuple(state.get) if state.exists else None

    def is_new(at: pd.Series, etag: pd.Series) -> pd.Series:
        if known is None:
            return pd.Series(True, index=at.index)
        return (at > known[0]) | ((at == known[0]) & (etag > known[1]))

    def against(rows: pd.DataFrame, etag, set_changed) -> pd.DataFrame:
        """Those of the rows that differ from what came before, which had ``etag``."""
        made = pd.DataFrame({"source": key[0], "at": rows["at"], "etag": rows["etag"], "previous_etag": etag})
        made["etag_changed"], made["set_changed"] = made["etag"] != made["previous_etag"], set_changed
        return made[made["etag_changed"] | made["set_changed"]]

    firsts: list[tuple] = []
    lasts: list[tuple] = []
    for batch in batches:
        rows = batch[is_new(batch["at"], batch["etag"])]
        lasts += rows.loc[rows["ends"], ["at", "etag", "digest"]].itertuples(index=False, name=None)
        # The first new one after what is known has come after an older one in its range, or after none.
        inside = rows["follows"] & is_new(rows["before_at"], rows["before_etag"])
        firsts += rows.loc[~inside, ["at", "etag", "digest"]].itertuples(index=False, name=None)
        rows = rows[inside]
        yield against(rows, rows["before_etag"], rows["set_changed"])
    firsts.sort()
    lasts.sort()
    # Ranges don't overlap: the n-th one that begins follows the one that ends before it.
    before = [known or (None, "", ""), *lasts[:-1]]
    joined = pd.DataFrame(firsts, columns=["at", "etag", "digest"]).astype({"at": "int64"})
    if len(joined):
        yield against(joined, [b[1] for b in before], joined["digest"] != pd.Series([b[2] for b in before]))
        state.update(lasts[-1])


def stream_changes(responses: DataFrame) -> DataFrame:
    """``source, fetched_at, etag, previous_etag, etag_changed, set_changed``: valid snapshots that differ from the one before.

    ``responses`` is a stream. Snapshots of a source are taken in order of time and etag within each batch. One that doesn't come after the last
    one taken is a repeat or too late, and is skipped, so a response that is landed twice changes nothing. The first snapshot is compared with an empty etag and an empty
    set; of several under one time and etag, that with the least digest counts. A set is known by a digest of its distinct ranges in order. A NULL source is a source, and its snapshots without a time come first.
    State is three short values for each source. A batch is cut into ranges of the order, as many as shuffle partitions, and a task holds the distinct
    snapshots of one range, without their address ranges. The task of a source holds only the ends of these ranges: the rows between them pass by.
    """
    snapshots = valid_snapshots(responses)
    ranges = F.array_sort(F.array_distinct(F.filter(F.concat("ipv4_cidrs", "ipv6_cidrs"), lambda c: c.isNotNull())))
    slim = snapshots.select(
        "source",
        F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(_NO_TIME)).alias("at"),
        "etag",
        F.when(F.size(ranges) > 0, F.sha2(F.array_join(ranges, "\n"), 256)).otherwise("").alias("digest"),
    )
    followed = slim.repartitionByRange("source", "at", "etag").mapInArrow(_followed, _FOLLOWED)
    changes = followed.groupBy("source").applyInPandasWithState(_changes, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)
    moment = F.when(F.col("at") != _NO_TIME, F.timestamp_micros("at").cast("timestamp_ntz"))
    return changes.select("source", moment.alias("fetched_at"), "etag", "previous_etag", "etag_changed", "set_changed")


def start_change_stream(changes: DataFrame, path: str, checkpoint: str, interval: str | None = DEFAULT_INTERVAL) -> StreamingQuery:
    """Append changes to Parquet. ``interval`` None takes what is there and ends; state and progress are in ``checkpoint``."""
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()
