"""Quality rules: plain counts of a text, and how far its distributions are from those of a language.

Two histograms of each text are compared with references by the Jensen-Shannon distance: one over classes of characters, one
over the commonest words of a language, with all other words as one. References are the same histograms added up over all
documents of a language; a text is held against its nearest one, whatever its label says. Small histograms are noisy, so each
comparison needs a least number of characters or words, and the allowed distance grows as the sample shrinks.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.columns import back, own

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

# The classes of characters.
CLASSES = ("lower", "upper", "letter", "number", "space", "stop", "punctuation", "symbol", "marked", "other")
_LOWER, _UPPER, _LETTER, _NUMBER, _SPACE, _STOP, _PUNCTUATION, _SYMBOL, _MARKED, _OTHER = range(len(CLASSES))

# Base rules: words that a text needs, and the part of its words, in percent, that repeated windows may hold.
LEAST_WORDS = 50
MOST_REPEATED = 50

# Words of a language that have a bin of their own, and the most languages (those with most words) that become references.
COMMON_WORDS = 32
MOST_LANGUAGES = 1000

# Least characters and words of a comparison, and the distances allowed to a very long text.
LEAST_CHARS = 200
LEAST_COMPARED = 50
CLASS_DISTANCE = 0.15
WORD_DISTANCE = 0.25

# Entries of a task's counters before they are handed on.
_HELD = 200_000


def _class_of(code: int) -> int:
    char = chr(code)
    if char in SPACES:
        return _SPACE
    if char in SYMBOLS:
        return _MARKED
    if char in ".,":
        return _STOP
    kind = unicodedata.category(char)
    if kind in ("Ll", "Lu", "Lt"):
        return _LOWER if kind == "Ll" else _UPPER
    return {"L": _LETTER, "M": _LETTER, "N": _NUMBER, "P": _PUNCTUATION, "S": _SYMBOL}.get(kind[0], _OTHER)


_table: np.ndarray | None = None


def classes_of(text: str) -> np.ndarray:
    """How many characters of each class a text has."""
    global _table
    if _table is None:
        _table = np.array([_class_of(code) for code in range(sys.maxunicode + 1)], dtype=np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(_table[codes], minlength=len(CLASSES))


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def folded(text: str) -> str:
    """A-Z read as a-z, all else as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def repeated_words(words: list[str]) -> int:
    """Words that stand in windows of three words found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], dtype=np.int64)
    # Pairs are numbered first, so that keys stay below the square of the number of words.
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    inside = np.zeros(len(words), dtype=bool)
    for j in range(3):
        inside[j : j + len(again)] |= again
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (0 to 1) of counts to each row of reference shares."""
    p = counts / counts.sum(axis=-1, keepdims=True)
    middle = (p + references) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(middle > 0, middle, 1)), 0).sum(axis=-1)

    return np.sqrt(np.maximum((part(p) + part(references)) / 2, 0))


def allowed(limit: float, bins: int, n: int) -> float:
    """``limit``, and the distance that ``n`` draws from the reference itself have on average in ``bins`` bins."""
    return limit + (bins / (8 * n * np.log(2))) ** 0.5


@dataclass
class References:
    """Of each language, the shares of character classes, its common words, and their shares with all others' at last."""

    classes: np.ndarray
    words: list[dict[str, int]]
    shares: np.ndarray

    def __len__(self) -> int:
        return len(self.words)


def _counted(batches):
    """(lang, kind, word, n) of one task's texts: each word, the characters of each class by its number, and all words together."""
    words: dict[str, Counter] = defaultdict(Counter)
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), dtype=np.int64))
    totals: Counter = Counter()
    held = 0

    def rows(kind: str, counts: dict[str, dict[str, int]]):
        for lang, found in counts.items():
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "kind", "word", "n"],
            )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            found = words_of(folded(text))
            classes[lang] += classes_of(text)
            totals[lang] += len(found)
            held -= len(words[lang])
            words[lang].update(found)
            held += len(words[lang])
            if held > _HELD:
                yield from rows("word", words)
                words.clear()
                held = 0
    yield from rows("word", words)
    yield from rows("class", {lang: {str(i): int(n) for i, n in enumerate(found) if n} for lang, found in classes.items()})
    yield from rows("total", {lang: {"": n} for lang, n in totals.items()})


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> References:
    """References of all languages that documents name, from all documents with a text and a language.

    Ties of common words go to the smaller word. Languages without a word are left out; without documents there are no references.
    What comes to the driver is bounded: ``COMMON_WORDS`` words and the classes of ``MOST_LANGUAGES`` languages.
    """
    named = docs.select(F.col(f"`{lang_column}`").cast("string").alias("lang"), F.col(f"`{text_column}`").cast("string").alias("text"))
    counted = named.filter("lang is not null and text is not null").mapInArrow(_counted, "lang string, kind string, word string, n long")
    counts = counted.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(COMMON_WORDS, len(CLASSES)))
    total = F.max(F.when(F.col("kind") == "total", F.col("n"))).over(Window.partitionBy("lang"))
    # A language has at most so many rows here, so the limit holds whole languages.
    most = MOST_LANGUAGES * (COMMON_WORDS + len(CLASSES) + 1)
    small = top.filter(f"kind <> 'word' or rank <= {COMMON_WORDS}").withColumn("total", total).filter("total > 0")
    by_lang: dict[str, list] = defaultdict(list)
    for row in small.orderBy(F.desc("total"), "lang", "kind", "rank").limit(most).collect():
        by_lang[row["lang"]].append(row)
    classes, words, shares = [], [], []
    for rows in list(by_lang.values())[:MOST_LANGUAGES]:
        found = np.zeros(len(CLASSES))
        for row in rows:
            if row["kind"] == "class":
                found[int(row["word"])] = row["n"]
        common = [row for row in rows if row["kind"] == "word"]
        bins = np.zeros(COMMON_WORDS + 1)
        bins[: len(common)] = [row["n"] for row in common]
        bins[-1] = rows[0]["total"] - bins.sum()
        classes.append(found / found.sum())
        words.append({row["word"]: i for i, row in enumerate(common)})
        shares.append(bins / bins.sum())
    return References(np.array(classes).reshape(-1, len(CLASSES)), words, np.array(shares).reshape(-1, COMMON_WORDS + 1))


def _judge(text: str, references: References) -> tuple:
    words = words_of(text)
    kinds = classes_of(text)
    n_words, n_chars = len(words), len(text)
    repeated = repeated_words(words)
    failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
    by_class = by_word = None
    near = True
    if len(references) and n_chars >= LEAST_CHARS:
        by_class = float(distance(kinds, references.classes).min())
        near &= by_class <= allowed(CLASS_DISTANCE, len(CLASSES), n_chars)
    if len(references) and n_words >= LEAST_COMPARED:
        counted = Counter(words_of(folded(text)))
        bins = np.zeros((len(references), COMMON_WORDS + 1))
        for row, common in enumerate(references.words):
            for word, place in common.items():
                bins[row, place] = counted.get(word, 0)
        bins[:, -1] = n_words - bins.sum(axis=1)
        by_word = float(distance(bins, references.shares).min())
        near &= by_word <= allowed(WORD_DISTANCE, COMMON_WORDS + 1, n_words)
    return (
        n_words, n_chars - int(kinds[_SPACE]), int(kinds[_MARKED]), duplicate_lines(text), repeated,
        failed, by_class, by_word, bool(near and not failed),
    )


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " class_distance double, word_distance double, kept boolean"
)


def judge(docs: DataFrame, references: References, text_column: str = "text") -> DataFrame:
    """Append the counts, ``base_failed``, both distances and ``kept`` to each document; other columns stay.

    A null or empty text has no words and fails. A distance is null where the text is too short for the comparison or there
    are no references; such a comparison rejects nothing. Repeated rows are judged alike, each for itself. Columns of these names are replaced.
    """
    names = [part.split()[0] for part in RESULT.split(",")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = list(zip(*(_judge(text.as_py() or "", references) for text in texts))) or [[]] * len(names)
            added = [pa.array(column, kind) for column, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *names])

    kept = [c for c in docs.columns if c not in names]
    given = docs.select(*own(docs, tuple(names)), F.col(f"`{text_column}`").cast("string").alias("_judged"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    found = given.mapInArrow(run, f"{schema}, {RESULT}")
    return found.select(*back(docs.select(*[f"`{c}`" for c in kept])), *names)
