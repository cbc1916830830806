"""Aligning the tokens that two tokenizers make of one text, and counting which ids overlap.

Both tokenizers' tokens cover the same bytes, so each has an array of byte ends. Ends that both have cut the text into groups.
Stretches of one token against one are jumped: at the current shift between both indexes, slices of both arrays are
compared, of doubling length while they are equal, of halving length then. Where the ends differ the group is resolved token by
token, and the shift becomes that of the place behind it.

Documents are handled in blocks of bounded text. A block keeps its own list of the id pairs that it links, with the number of its
documents that hold each, and its documents refer to that list by place. Only these lists meet: pairs are counted over
all blocks, and each block gets the counts of its pairs back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.packing import Encoder

# The text, in code points, after which a block ends; a longer document makes a block of its own.
BLOCK_CHARS = 8_000_000
BLOCK_DOCUMENTS = 20_000

SPACE_MARK = "▁"


class Tokenizers:
    """The byte-level tokenizer A of a JSON file and the pieces B of a model file that adds a space in front."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.first = Encoder(byte_level).fast
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        size = self.second.get_piece_size()
        self.second_bytes = [self._piece(i) for i in range(size)]
        self.first_sizes = np.array([self._size(i) for i in range(self.first.n_vocab)])
        self.second_sizes = np.array([len(b) for b in self.second_bytes])

    def _size(self, number: int) -> int:
        try:
            return len(self.first.decode_single_token_bytes(number))
        except KeyError:
            return 0

    def _piece(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        if self.second.is_byte(number):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for each text; None for a text that either doesn't give back."""
        for text, second in zip(texts, self.second.encode(texts, num_threads=1)):
            whole = " " + text
            first = self.first.encode_to_numpy(whole, disallowed_special=())
            data = whole.encode()
            if not text or b"".join([self.second_bytes[i] for i in second]) != data:
                yield None
            elif self.first.decode_bytes(first.tolist()) != data:
                yield None
            else:
                yield first.astype(np.int64), np.array(second, dtype=np.int64)


@cache
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


@dataclass
class Alignment:
    """``runs``: (first A token, first B token, length) of one-to-one stretches; ``groups``: (A start, A end, B start, B end) of all
    others. Both in order, by place."""

    runs: np.ndarray
    groups: np.ndarray


def align(first: list[int], second: list[int]) -> Alignment:
    """Groups of two lists of ends, which ascend and have the last end in common."""
    runs: list[int] = []
    groups: list[int] = []
    i = j = 0
    n = len(first)
    while i < n:
        a, b = first[i], second[j]
        if a == b:
            length = _run(first, second, i, j)
            runs += (i, j, length)
            i += length
            j += length
        else:
            start, other = i, j
            while a != b:
                if a < b:
                    i += 1
                    a = first[i]
                else:
                    j += 1
                    b = second[j]
            i += 1
            j += 1
            groups += (start, i, other, j)
    return Alignment(np.array(runs, dtype=np.int64).reshape(-1, 3), np.array(groups, dtype=np.int64).reshape(-1, 4))


# The first slice that is compared, and the longest in which a difference is looked for end by end.
_PROBE = 4
_NEAR = 16


def _run(first: list[int], second: list[int], i: int, j: int) -> int:
    """How many ends from ``i`` and ``j`` on are equal, the first being so."""
    a, b, step = i + 1, j + 1, _PROBE
    most = min(len(first) - i, len(second) - j) + i
    # A slice that reaches past the shorter array differs unless both end there.
    while a < most and first[a : a + step] == second[b : b + step]:
        a += step
        b += step
        step *= 2
    if a >= most:
        return most - i
    while step > _NEAR:
        step //= 2
        if first[a : a + step] == second[b : b + step]:
            a += step
            b += step
    while a < most and first[a] == second[b]:
        a += 1
        b += 1
    return a - i


def last_of_groups(found: Alignment, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Which A tokens and B tokens are the last of their group."""
    runs, groups = found.runs, found.groups
    lengths = runs[:, 2]
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    marks = np.zeros(n_a, dtype=bool), np.zeros(n_b, dtype=bool)
    for side, mark in enumerate(marks):
        mark[np.repeat(runs[:, side], lengths) + inside] = True
        mark[groups[:, 2 * side + 1] - 1] = True
    return marks


def all_links(first: np.ndarray, second: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of all overlaps, from their ends and the last B tokens of groups: each A token with the B token
    that its first byte is in, and each B token that doesn't start a group with the A token that its first byte is in."""
    starts = np.concatenate([[0], first[:-1]]) if len(first) else first
    at = np.searchsorted(second, starts, side="right")
    inner = np.flatnonzero(~last[:-1]) + 1
    over = np.searchsorted(first, second[inner - 1], side="right")
    return np.concatenate([np.arange(len(first)), over]), np.concatenate([at, inner])


@cache
def _numerals(size: int, inside: str, end: str) -> np.ndarray:
    """Of each id, its decimal digits with the mark that stands inside a group, and behind it with that at the end; zeros fill up."""
    width = len(str(size)) + 1
    rows = [f"{i}{mark}".encode().rjust(width, b"\0") for i in range(size) for mark in (inside, end)]
    return np.frombuffer(b"".join(rows), dtype=f"S{width}")


def groups_text(first: np.ndarray, second: np.ndarray, last: tuple[np.ndarray, np.ndarray]) -> bytes:
    """``a1,a2|b1;a3|b2``: the ids of each group in order."""
    if not len(first):
        return b""
    group = [np.cumsum(mark) - mark for mark in last]
    a_ends, b_ends = (np.flatnonzero(mark) + 1 for mark in last)
    size = 1 << max(int(first.max()), int(second.max())).bit_length()
    tables = _numerals(size, ",", "|"), _numerals(size, ",", ";")
    text = np.empty(len(first) + len(second), dtype=tables[0].dtype)
    text[np.arange(len(first)) + np.concatenate([[0], b_ends])[group[0]]] = tables[0][2 * first + last[0]]
    text[np.arange(len(second)) + a_ends[group[1]]] = tables[1][2 * second + last[1]]
    data = text.view(np.uint8)
    return data[data != 0].tobytes()[:-1]


class _Block:
    """Documents of one block, until it is handed on."""

    def __init__(self, number: int):
        self.number = number
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, row: tuple, pairs: np.ndarray, times: np.ndarray, chars: int) -> None:
        self.rows.append(row)
        self.pairs.append(pairs)
        self.times.append(times)
        self.chars += chars

    def batches(self) -> Iterator[pa.RecordBatch]:
        sizes = [len(p) for p in self.pairs]
        every = np.concatenate(self.pairs)
        listed, places, counts = np.unique(every, return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes)
        places = places.astype("<u4")
        columns = list(zip(*self.rows))
        yield _batch(
            [*columns, [places[e - n : e].tobytes() for e, n in zip(ends, sizes)], [t.astype("<u4").tobytes() for t in self.times]],
            [self.number] * len(sizes),
        )
        # The block's list is a row of its own.
        yield _batch([[None]] * len(_STORED_DOC) + [[listed.astype("<i8").tobytes()], [counts.astype("<i8").tobytes()]], [self.number])


_STORED_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_STORED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"


def _batch(columns: list, blocks: list[int]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
    arrays = [pa.array(blocks, pa.int64())] + [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in _STORED.split(", ")])


def _aligned(byte_level: str, pieces: str):
    nothing = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 64):
                texts = [text.as_py() or "" for text in batch.column(1)[at : at + 64]]
                for doc_id, text, tokens in zip(ids[at : at + 64], texts, both(texts)):
                    if tokens is None:
                        block.add((doc_id, 0, 0, 0, 0, ""), nothing, nothing, 0)
                    else:
                        block.add(*_document(both, doc_id, *tokens), len(text))
                    if block.chars >= BLOCK_CHARS or len(block.rows) >= BLOCK_DOCUMENTS:
                        yield from block.batches()
                        number += 1
                        block = _Block(number)
        if block.rows:
            yield from block.batches()

    return run


def _document(both: Tokenizers, doc_id: int, first: np.ndarray, second: np.ndarray) -> tuple:
    ends = both.first_sizes[first].cumsum(), both.second_sizes[second].cumsum()
    last = last_of_groups(align(ends[0].tolist(), ends[1].tolist()), len(first), len(second))
    a, b = all_links(*ends, last[1])
    pairs, times = np.unique(first[a] << 32 | second[b], return_counts=True)
    digest = hashlib.sha256(groups_text(first, second, last)).hexdigest()
    return (doc_id, len(first), len(second), int(last[0].sum()), len(a), digest), pairs, times


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, pair, n) of the blocks' lists."""
    for batch in batches:
        for block, pairs, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            pairs, counts = np.frombuffer(pairs, dtype="<i8"), np.frombuffer(counts, dtype="<i8")
            arrays = [np.full(len(pairs), block), np.arange(len(pairs), dtype=np.int32), pairs, counts]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["block", "place", "pair", "n"])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(_key, documents: pa.Table, answers: pa.Table) -> pa.Table:
    """The sums of a block's documents from the counts of its pairs."""
    size = len(answers)
    counts, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    place = answers["place"].to_numpy()
    counts[place] = answers["count"].to_numpy()
    best[place] = answers["best"].to_numpy(zero_copy_only=False)
    n_best, sums = [], []
    for places, times in zip(documents["places"].to_pylist(), documents["times"].to_pylist()):
        places, times = np.frombuffer(places, dtype="<u4"), np.frombuffer(times, dtype="<u4").astype(np.int64)
        n_best.append(int(times[best[places]].sum()))
        sums.append(int((times * counts[places]).sum()))
    kept = [documents[c] for c in _STORED_DOC]
    arrays = [*kept[:-1], pa.chunked_array([pa.array(n_best, pa.int64())]), pa.chunked_array([pa.array(sums, pa.int64())]), kept[-1]]
    return pa.Table.from_arrays(arrays, names=[part.split()[0] for part in _RESULT.split(", ")])


def overlaps(
    spark: SparkSession, docs: DataFrame, folder: str, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each document: ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``byte_level`` and ``pieces`` are the paths of the two tokenizers' files on the executors. Links are overlaps of an A token and a B token. A pair of ids counts
    the documents that hold it linked; ``n_best`` are the links whose pair has its A id's highest count, ties included, and ``count_sum`` adds up the
    counts of all links. Null and empty texts, and those that one of the tokenizers doesn't give back byte by byte, have no tokens: zeros and ''. Equal
    rows and repeated ids are documents of their own; a null id stays null; an empty table gives no rows. ``folder``, shared by all executors, takes the
    aligned documents and the counts.
    """
    given = docs.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string"))
    given.mapInArrow(_aligned(byte_level, pieces), _STORED).write.option("compression", "zstd").parquet(f"{folder}/aligned")
    stored = spark.read.parquet(f"{folder}/aligned")
    listed = stored.filter("n_a is null").select("block", "places", "times").mapInArrow(_listed, "block long, place int, pair long, n long")
    listed.groupBy("pair").agg(F.sum("n").alias("count")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    # One row for each A id, so its vocabulary bounds what is broadcast.
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("first")).agg(F.max("count").alias("highest"))
    known = counts.join(F.broadcast(highest), first == F.col("first")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    asked = spark.read.parquet(f"{folder}/aligned").filter("n_a is null").select("block", "places", "times")
    asked = asked.mapInArrow(_listed, "block long, place int, pair long, n long").select("block", "place", "pair")
    answers = asked.join(known, "pair").select("block", "place", "count", "best")
    documents = stored.filter("n_a is not null")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed, _RESULT)
