"""Packing token ids into fixed windows by minimum bin slack.

Every document is tokenized in the task that reads it and cut into full windows; only what remains
of each goes into a pool. A window starts with the longest remainder in the pool. A subset-sum dynamic
programme over the lengths present, held as the bits of one integer, finds the multiset of further
lengths that comes closest to the capacity, and backtracking gives how many of each length it takes; the same
multiset is used again as often as the counts allow. Where nothing fits exactly, one more
remainder is cut to fill the gap. What is left at the end of a task is cut at powers of two,
which need no padding.

Nothing is shuffled: a task's pool is bounded, and tasks don't meet. Sequence ids combine the
partition and a running number, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 1024
END_ID = 0

# The remainders that a task holds before it packs, and those it keeps to choose from later.
POOL = 4096
KEEP = 1024

_ROWS_OUT = 2000


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes for code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit arrays.

    Ranks come from the file's own vocabulary and run in the faster public encoder; texts that name
    a special token go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec.get("added_tokens", ())]
        to_byte = _byte_of()
        ranks = {
            bytes(to_byte[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.whole = Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if any(token in text for token in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``capacity``
    from below; longer lengths are preferred."""
    mask = (2 << capacity) - 1
    reach = 1
    before: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        most = min(counts[length], capacity // length)
        before.append((length, most, reach))
        step = 1
        left = most
        while left:
            taken = min(step, left)
            reach |= (reach << (taken * length)) & mask
            left -= taken
            step *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen = {}
    for length, most, reach in reversed(before):
        for used in range(most + 1):
            rest = total - used * length
            if rest >= 0 and reach >> rest & 1:
                break
        if used:
            chosen[length] = used
        total -= used * length
    return chosen


class Packer:
    """Packs the documents of one task; ``rows`` gathers (document, start, ids, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int):
        self.window = window
        self.next_sequence = first_sequence
        self.pool: dict[int, list[tuple]] = {}
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, document: tuple, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._write([(document, start, ids[start : start + self.window])])
        if whole < len(ids):
            self._put((document, whole, ids[whole:]))
        if self.size >= POOL:
            self.pack(KEEP)

    def pack(self, keep: int) -> None:
        """Fill windows until at most ``keep`` remainders are in the pool."""
        while self.size > keep:
            longest = max(self.pool)
            counts = {length: len(items) for length, items in self.pool.items()}
            counts[longest] -= 1
            recipe = fullest(counts, self.window - longest)
            recipe[longest] = recipe.get(longest, 0) + 1
            times = min(len(self.pool[length]) // n for length, n in recipe.items())
            gap = self.window - sum(length * n for length, n in recipe.items())
            for _ in range(times if not gap else 1):
                pieces = [self._take(length) for length, n in recipe.items() for _ in range(n)]
                if gap and self.pool:
                    document, start, ids = self._take(max(self.pool))
                    pieces.append((document, start, ids[:gap]))
                    self._put((document, start + gap, ids[gap:]))
                    gap = 0
                if gap:
                    self._write_cut(pieces)
                else:
                    self._write(pieces)

    def _take(self, length: int) -> tuple:
        items = self.pool[length]
        item = items.pop()
        if not items:
            del self.pool[length]
        self.size -= 1
        return item

    def _put(self, piece: tuple) -> None:
        self.pool.setdefault(len(piece[2]), []).append(piece)
        self.size += 1

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for document, start, ids in pieces:
            self.rows.append((document, start, ids, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def _write_cut(self, pieces: list[tuple]) -> None:
        """The last pieces, as sequences whose lengths are powers of two."""
        left = sum(len(piece[2]) for piece in pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                document, start, ids = pieces.pop(0)
                now.append((document, start, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (document, start + room, ids[room:]))
                room -= min(room, len(ids))
            self._write(now)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``window`` ids.

    Columns: the id column, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset``. Each document is its text's ids and then ``end_id``; a null
    or empty text is ``end_id`` alone. Repeated rows and null ids are documents of their own. Other
    columns are left out, and an empty table gives no rows. Sequences are full or a power of two long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], dtype="<u4"))
                packer.add((doc_id.as_py(), len(ids)), ids.astype("<u4", copy=False))
                if len(packer.rows) >= _ROWS_OUT:
                    yield from _batches(packer, schema)
        packer.pack(0)
        yield from _batches(packer, schema)

    id_type = docs.schema[id_column].dataType
    fields = [
        T.StructField(id_column, id_type),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType(fields))
    return docs.select(f"`{id_column}`", f"`{text_column}`").mapInArrow(run, T.StructType(fields))


def _batches(packer: Packer, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, packer.rows = packer.rows, []
    for at in range(0, len(rows), _ROWS_OUT):
        part = rows[at : at + _ROWS_OUT]
        columns = [
            [document[0] for document, *_ in part],
            [start for _, start, *_ in part],
            [len(ids) for _, _, ids, *_ in part],
            [ids.tobytes() for _, _, ids, *_ in part],
            [document[1] for document, *_ in part],
            [sequence for *_, sequence, _ in part],
            [offset for *_, offset in part],
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(columns, schema)], schema=schema
        )
