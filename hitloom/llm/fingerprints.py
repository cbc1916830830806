"""One-permutation MinHash fingerprints of texts, packed to a few bits per bin.

Every shingle is hashed once. The top bits of the hash choose a bin, which keeps its smallest hash; an empty bin
borrows from bins that a fixed random sequence names, the first non-empty one (optimal densification). Of each bin only
the low bits are stored. Two sets whose bins agree by chance are allowed for when likeness is estimated.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.llm.text import mix, shingle_hashes, slices, word_hashes

SHINGLE = 5
BINS = 256
BITS = 4

_EMPTY = np.uint64(2**64 - 1)
_BIN_STEP = np.uint64(0x9E3779B97F4A7C15)
_BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())


def bin_minima(shingles) -> np.ndarray:
    """The smallest hash in each bin of each text."""
    counts = np.diff(shingles.bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    minima = np.full(len(counts) * BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(minima, rows * BINS + (shingles.hashes >> _BIN_SHIFT).astype(np.int64), shingles.hashes)
    return minima.reshape(-1, BINS)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has a full one."""
    full = minima != _EMPTY
    filled = minima.copy()
    number = full.sum(axis=1)
    alone = np.flatnonzero(number == 1)
    if len(alone):
        filled[alone] = minima[alone].min(axis=1)[:, None]
    rows, bins = np.nonzero(~full & (number > 1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        donors = mix(bins.astype(np.uint64) + np.uint64(attempt * BINS)) % np.uint64(BINS)
        values = minima[rows, donors.astype(np.int64)]
        found = values != _EMPTY
        filled[rows[found], bins[found]] = values[found]
        rows, bins = rows[~found], bins[~found]
    return filled


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The bins' low bits of all texts, one byte each; a row of 255 is a text without words."""
    codes = []
    for part in slices(column):
        shingles = shingle_hashes(word_hashes(part), SHINGLE)
        # Mixed with the bin, so that a value that many bins hold doesn't give them all the same bits.
        values = mix(densify(bin_minima(shingles)) + np.arange(BINS, dtype=np.uint64) * _BIN_STEP)
        low = (values & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        low[np.diff(shingles.bounds) == 0] = 255
        codes.append(low)
    return np.concatenate([np.zeros((0, BINS), dtype=np.uint8), *codes])


def packed(codes: np.ndarray) -> list[str]:
    """Fingerprints as base64 text; that of a text without words is empty."""
    shift = np.arange(8 // BITS, dtype=np.uint8) * BITS
    grouped = (codes.reshape(len(codes), -1, 8 // BITS) << shift).sum(axis=2).astype(np.uint8)
    return ["" if code[0] == 255 else base64.b64encode(row.tobytes()).decode() for code, row in zip(codes, grouped)]


def unpacked(fingerprint: str) -> np.ndarray:
    if not fingerprint:
        return np.full(BINS, 255, dtype=np.uint8)
    data = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8)
    shift = np.arange(8 // BITS, dtype=np.uint8) * BITS
    return ((data[:, None] >> shift) & ((1 << BITS) - 1)).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of codes. Two texts without words are alike (1), one is like no other (0)."""
    chance = 2.0**-BITS
    agree = (a == b).mean(axis=1)
    estimate = np.clip((agree - chance) / (1 - chance), 0, 1)
    bare = (a[:, 0] == 255).astype(int) + (b[:, 0] == 255)
    return np.where(bare == 2, 1.0, np.where(bare == 1, 0.0, estimate))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, from the start of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_ROW = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_EDGE = [("slot", pa.int64()), ("head_text", pa.large_string()), ("tail_text", pa.large_string())]


def _measures(texts: list[str], following: list[str]) -> list[list]:
    """The columns of ``_ROW`` for texts and the texts after them."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    own = fingerprints_of(pa.array(texts, pa.large_string()))
    other = fingerprints_of(pa.array(changed, pa.large_string()))
    after = own[1:] if texts[1:] == following[:-1] else fingerprints_of(pa.array(following[:-1], pa.large_string()))
    after = np.concatenate([after, fingerprints_of(pa.array(following[-1:], pa.large_string()))])
    return [
        [len(text) for text in texts],
        [hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for text in changed],
        packed(own), packed(other), likeness(own, other).tolist(), likeness(own, after).tolist(),
    ]


_STEP_BYTES = 4_000_000


def with_edits(spark: SparkSession, docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint each text and its edited form, which ends in the start of the next document's text.

    Columns: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    The next document is the one with the largest smaller id; after the last comes the first, so a lone
    document is its own. Null ids come last, rows with one id are ordered by a hash of the text and equal rows follow
    each other. A null text is empty. Other columns are left out, and an empty table gives none.

    Documents are dealt out by ranges of the id and each task reads its range in order; texts move once. What the ranges'
    first and last documents need of each other is joined afterwards: two texts for each partition.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(docs.schema[id_column].dataType)
    order = [F.desc_nulls_last("_id"), F.asc("_tie"), F.asc("_row")]
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text).alias("_tie"), F.monotonically_increasing_id().alias("_row"), text.alias("_text")
    )
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    schema = pa.schema([("_id", id_arrow), *_ARROW, *_EDGE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, waiting, started = None, [], False
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if not started:
                    head, started = value, True
                waiting.append((doc_id, value))
                if len(waiting) > 1 and sum_bytes(waiting):
                    yield done(waiting)
                    waiting[:] = waiting[-1:]
                    held[0] = 0
        if len(waiting) > 1:
            yield done(waiting)
        if started:
            doc_id, tail = waiting[-1]
            values = [doc_id, *[None] * len(_ARROW), TaskContext.get().partitionId(), head, tail]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)
        held[0] = 0

    held = [0]

    def sum_bytes(waiting: list) -> bool:
        held[0] += len(waiting[-1][1])
        return held[0] >= _STEP_BYTES

    def done(waiting: list) -> pa.RecordBatch:
        texts = [value for _, value in waiting]
        columns = [[doc_id for doc_id, _ in waiting[:-1]], *_measures(texts[:-1], texts[1:])]
        columns += [[None] * (len(texts) - 1)] * len(_EDGE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    ranged.mapInArrow(run, f"_id {id_type}, {_ROW}, slot bigint, head_text string, tail_text string").write.parquet(folder)
    stored = spark.read.parquet(folder)
    inside = stored.filter("slot is null").select("_id", *[n for n, _ in _ARROW])
    across = Window.orderBy("slot")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = stored.filter("slot is not null").select(
        "_id", "tail_text", F.coalesce(F.lead("head_text").over(across), F.first("head_text").over(whole)).alias("next_text")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [[batch.column(0)[i].as_py()], *_measures([batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()])]
                kinds = [id_arrow, *[t for _, t in _ARROW]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_id", *[n for n, _ in _ARROW]])

    closed = edges.mapInArrow(close, f"_id {id_type}, {_ROW}")
    return inside.unionByName(closed).withColumnRenamed("_id", id_column)
