"""Stupid-backoff language-model scores, with counts of the corpus itself.

Documents are dealt out in blocks. Each block lists its distinct words and word pairs once, with their counts, by ranges of
their hashes: these are the exploded n-grams, added up before they move. A range's task adds the lists of all blocks into its
part of the count table and answers each block with the counts of what it listed, in the same order. Each block
then scores its documents word by word. An n-gram that every document has is one entry per block, so no
task sees more of it than there are blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.text import mix, slices, word_hashes

# The factor for each step to a shorter n-gram, and the least count of a pair that has a score of its own.
BACKOFF = 0.4
LEAST_COUNT = 2

# Scores are sums of whole millionths, so that they don't depend on the order of adding.
UNIT = 1_000_000

BLOCK_CHARS = 16_000_000

_PAIR = np.uint64(0xD6E8FEB86659FD93)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first * _PAIR) + second)


def _block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and where each text's begin."""
    hashes, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for part in slices(texts):
        words = word_hashes(part)
        hashes.append(words.hashes)
        sizes.append(np.diff(words.bounds))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _block_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' bounds; sorted distinct n-grams with counts; the place among them of each word, then of each pair.

    The pair at a text's first word is with nothing, and isn't to be used.
    """
    words, bounds = _block_words(texts)
    pairs = np.zeros_like(words)
    pairs[1:] = pair_hashes(words[:-1], words[1:])
    inner = np.ones(len(words), dtype=bool)
    inner[bounds[:-1][bounds[:-1] < len(words)]] = False
    used = np.concatenate([words, pairs[inner]])
    grams, places, counts = np.unique(used, return_inverse=True, return_counts=True)
    all_places = np.zeros(2 * len(words), dtype=np.int64)
    all_places[np.concatenate([np.ones(len(words), dtype=bool), inner])] = places
    return bounds, grams, counts, all_places


def _ranges(grams: np.ndarray, number: int) -> np.ndarray:
    """Where each of ``number`` equal ranges of hash values begins, with the end at last."""
    limits = [-(-(i << 64) // number) for i in range(1, number)]
    return np.concatenate([[0], np.searchsorted(grams, np.array(limits, dtype=np.uint64)), [len(grams)]])


def _as_texts(series: pd.Series) -> pa.Array:
    return pa.array(series, pa.large_string(), from_pandas=True)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``n_words``, ``log_score`` (millionths, long) and ``mean_log_score`` (double, null without words) of every row.

    A word scores the log of its pair's count with the word before over that word's count, if the pair occurs ``LEAST_COUNT`` times;
    else, and at the start of a text, ``BACKOFF`` times the word's share of all words (at the start, its share). Counts are of all
    documents. A null or empty text has no words and scores 0. Repeated rows are counted and scored each; equal texts score the same.
    Other columns are left out, and an empty table gives no rows.
    """
    identity, text = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    id_type = docs.schema[id_column].dataType.simpleString()
    chars = docs.agg(F.sum(F.char_length(text))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64(identity, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = docs.select(identity.alias("_id"), text.alias("_text"), block.alias("_block")).repartition(F.col("_block"))

    def listed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, grams, counts, _ = _block_grams(_as_texts(frame["_text"]))
        at = _ranges(grams, blocks)
        full = [i for i in range(blocks) if at[i] < at[i + 1]]
        return pd.DataFrame(
            {
                "part": full,
                "block": [int(key[0])] * len(full),
                "grams": [grams[at[i] : at[i + 1]].tobytes() for i in full],
                "counts": [zlib.compress(counts[at[i] : at[i + 1]].astype("<u4").tobytes(), 1) for i in full],
            }
        )

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(x, dtype=np.uint64) for x in frame["grams"]]
        counts = [np.frombuffer(zlib.decompress(x), dtype="<u4") for x in frame["counts"]]
        table, places = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(len(table), dtype=np.int64)
        np.add.at(totals, places, np.concatenate(counts))
        answers = np.split(totals[places], np.cumsum([len(g) for g in grams])[:-1])
        return pd.DataFrame(
            {
                "part": frame["part"], "block": frame["block"],
                "totals": [zlib.compress(x.astype("<u8").tobytes(), 1) for x in answers],
            }
        )

    requests = dealt.groupBy("_block").applyInPandas(listed, "part int, block int, grams binary, counts binary")
    answers = requests.groupBy("part").applyInPandas(added, "part int, block int, totals binary")
    total = docs.agg(F.sum(_jvm_words(text))).first()[0] or 0

    def scored(key: tuple, frame: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        bounds, grams, _, places = _block_grams(_as_texts(frame["_text"]))
        parts = [np.frombuffer(zlib.decompress(x), dtype="<u8") for x in answered.sort_values("part")["totals"]]
        counts = np.concatenate([np.zeros(0, dtype="<u8"), *parts]).astype(np.float64)[places]
        words, pairs = counts[: len(counts) // 2], counts[len(counts) // 2 :]
        n = np.diff(bounds)
        first = np.zeros(len(words), dtype=bool)
        first[bounds[:-1][n > 0]] = True
        with np.errstate(divide="ignore", invalid="ignore"):
            context = np.concatenate([[1.0], words[:-1]])[: len(words)]
            share = np.where(first, words / total, BACKOFF * words / total) if len(words) else words
            likely = np.where(~first & (pairs >= LEAST_COUNT), pairs / context, share)
            logs = np.rint(np.log(likely) * UNIT).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(logs)])
        return pd.DataFrame({id_column: frame["_id"], "n_words": n, "log_score": sums[bounds[1:]] - sums[bounds[:-1]]})

    found = dealt.groupBy("_block").cogroup(answers.groupBy(F.col("block").alias("_block"))).applyInPandas(
        scored, f"`{id_column}` {id_type}, n_words long, log_score long"
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words") / UNIT)
    return found.withColumn("mean_log_score", mean)


def _jvm_words(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
