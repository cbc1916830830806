"""Mixing sources to target weights by a tree of multivariate hypergeometric draws.

Each source is a line of words: its documents in a random order, once for every pass that its target needs.
The part of the line up to the target is cut into blocks, so a source has an exact quota of them. A tree over the output
shards splits all quotas: at each node the left half of the shards draws its blocks without replacement. A
shard's blocks of a source are those that follow the blocks of the shards to its left, so shards
are disjoint and together take every block. Documents go where they start, and are shuffled within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.llm.columns import back, own

# The weights of sources in order, repeating, and the share of all words to take.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2

BLOCK_WORDS = 32_768
SHARD_BLOCKS = 64

# Documents in one part of a source's random order, on average, if it had all documents.
PART_ROWS = 4096
# Tree nodes that the first task makes before the work is dealt out.
FIRST_NODES = 1024

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: ``_key``, ``rank`` (from 0), ``source_size``, ``target`` in words and ``quota``, the target rounded.

    Sources by code point, null last, weigh as ``weights`` repeating. They share ``share`` times all words; a target stops at
    ``passes`` times its source's words and the excess is shared by weight among the rest. In order of
    the level at which sources fill up, the level of those that don't is what is left over their weight.
    """
    totals = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_most", passes * F.col("source_size"))
    by_level = Window.orderBy(F.col("_most") / F.col("_weight"), "rank")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.sum("_most").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_most")
    open_weight = F.sum("_weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - filled) / open_weight
    levels = ranked.withColumn("_level", level)
    first = F.first(
        F.when(F.col("_level") <= F.col("_most") / F.col("_weight"), F.col("_level")), ignorenulls=True
    ).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    most = F.col("_most").cast("double")
    target = F.least(most, F.coalesce(first * F.col("_weight"), most))
    return levels.withColumn("target", target).select(
        "_key", "rank", "source_size", "target", F.least(F.round("target").cast("long"), F.col("_most")).alias("quota")
    )


def split(low: int, high: int, quotas: np.ndarray, edges, seed: int) -> np.ndarray:
    """The left half's blocks of each source, drawn without replacement from the node's."""
    middle = (low + high) // 2
    wanted = edges(middle) - edges(low)
    rng = np.random.default_rng([seed, low, high])
    drawn = np.zeros_like(quotas)
    left = int(quotas.sum())
    for i, quota in enumerate(quotas):
        left -= int(quota)
        drawn[i] = rng.hypergeometric(int(quota), left, wanted) if wanted and quota and left else min(int(quota), wanted)
        wanted -= int(drawn[i])
    return drawn


def _shards(total: int, shard_blocks: int) -> int:
    return max(1, -(-total // shard_blocks))


def shard_blocks_of(sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """``shard``, ``rank``, ``first_block``, ``blocks``: which blocks of which source each shard takes.

    The root is one row with an entry for each source. One task makes the first nodes; the rest of the tree is
    grown below them in parallel.
    """
    root = sources.select(F.struct("rank", F.ceil(F.col("quota") / block_words).alias("blocks")).alias("s")).agg(
        F.sort_array(F.collect_list("s")).alias("s")
    ).select(
        F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), F.col("s.blocks").alias("quotas"),
        F.transform("s.blocks", lambda x: F.lit(0).cast("long")).alias("firsts"),
    )
    nodes = "low long, high long, quotas array<long>, firsts array<long>, total long, shards long"

    def children(low, high, quotas, firsts, total, shards):
        def edges(shard):
            return shard * total // shards

        drawn = split(low, high, quotas, edges, seed)
        middle = (low + high) // 2
        return (low, middle, drawn, firsts), (middle, high, quotas - drawn, firsts + drawn)

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                quotas = np.array(row.quotas, dtype=np.int64)
                total = int(quotas.sum())
                if not total:
                    continue
                shards = _shards(total, shard_blocks)
                level = [(0, shards, quotas, np.zeros_like(quotas))]
                while len(level) < FIRST_NODES and any(high - low > 1 for low, high, *_ in level):
                    level = [
                        child for node in level
                        for child in (children(*node, total, shards) if node[1] - node[0] > 1 else (node,))
                    ]
                for low, high, own, firsts in level:
                    yield pd.DataFrame({"low": [low], "high": [high], "quotas": [own], "firsts": [firsts], "total": [total], "shards": [shards]})

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                open_nodes = [(row.low, row.high, np.array(row.quotas, dtype=np.int64), np.array(row.firsts, dtype=np.int64))]
                while open_nodes:
                    low, high, quotas, firsts = open_nodes.pop()
                    if high - low > 1:
                        open_nodes += children(low, high, quotas, firsts, row.total, row.shards)
                        continue
                    used = np.flatnonzero(quotas)
                    yield pd.DataFrame({"shard": low, "rank": used, "first_block": firsts[used], "blocks": quotas[used]})

    first_nodes = root.mapInPandas(top, nodes).repartition(F.col("low"))
    return first_nodes.mapInPandas(below, "shard long, rank long, first_block long, blocks long")


def mix(
    spark: SparkSession, docs: DataFrame, folder: str, carry: list[str], text_column: str = "text", source_column: str = "source",
    block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11,
) -> DataFrame:
    """Draw a mixture; each row of ``docs`` comes back once, with what the mixture takes of it.

    Columns: those in ``carry``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``draws``, an array
    of (``pass``, ``taken``, ``shard``, ``place``), empty if nothing is taken. ``place`` orders a shard. A draw is the whole
    document except at the end of a source's target, where it is its first ``taken`` words. The words
    taken of a source are its target rounded. A null text has no words; a null source is a source. Repeated rows are
    documents of their own, in an order of their own; a source without words, and an empty table, take nothing. All draws
    depend on ids, sizes and ``seed`` alone. ``folder``, shared by all executors, takes a table.

    One row for each source is held together, as each node of the tree needs all of them.
    """
    source = F.col(f"`{source_column}`")
    size = word_count(F.col(f"`{text_column}`"))
    docs.select(
        *own(docs.select(*[f"`{c}`" for c in carry])), source.alias("source"), size.alias("size"),
        F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("_key"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in carry if c != text_column], size).alias("_hash"),
    ).withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sources = source_targets(rows.select("_key", "source", "size"))
    parts = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / PART_ROWS))

    passes = rows.select("_row", "_key", "size", F.explode(F.array(*[F.lit(p) for p in range(PASSES)])).alias("pass"), "_hash")
    passes = passes.withColumn("_order", F.xxhash64("_hash", "pass", F.lit(seed)))
    passes = passes.withColumn("_part", F.floor(F.pmod(F.shiftrightunsigned("_order", 20), F.lit(1 << 40)) * parts / float(1 << 40)))
    by_part = ["_key", "pass", "_part"]
    in_source = Window.partitionBy("_key", "pass").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = passes.groupBy(*by_part).agg(F.sum("size").alias("_words")).withColumn(
        "_ahead", F.sum("_words").over(in_source) - F.col("_words")
    ).join(sources.select("_key", "rank", "source_size", "target", "quota"), "_key")
    in_part = Window.partitionBy(*by_part).orderBy(
        F.shiftrightunsigned("_order", 20), "_order", "_hash", "size", "_row"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = passes.withColumn("_within", F.sum("size").over(in_part) - F.col("size")).join(ahead, by_part)
    start = F.col("pass") * F.col("source_size") + F.col("_ahead") + F.col("_within")
    placed = placed.withColumn("_start", start).withColumn(
        "taken", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start))
    ).withColumn("_block", F.when(F.col("taken") > 0, F.floor(F.col("_start") / block_words)))

    blocks = shard_blocks_of(sources, block_words, shard_blocks, seed).select(
        "shard", F.col("rank").alias("_rank"),
        F.explode(F.sequence("first_block", F.col("first_block") + F.col("blocks") - 1)).alias("_number"),
    )
    # A document that takes nothing meets no block, wherever its key sends it.
    on = (F.col("rank") == F.col("_rank")) & (F.coalesce("_block", -1 - F.col("_row")) == F.col("_number"))
    dealt = placed.join(blocks, on, "left")
    drawn = dealt.groupBy("_row").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("taken") > 0, F.struct(
            "pass", F.col("taken"), "shard", F.xxhash64("_order", "shard").alias("place")
        )))).alias("draws"),
    )
    carried = docs.select(*[f"`{c}`" for c in carry])
    return rows.drop("source", "_key", "_hash").join(drawn, "_row").select(*back(carried), "size", "source_size", "target", "taken", "draws")


def drawn_documents(mixed: DataFrame, text_column: str, columns: list[str]) -> DataFrame:
    """The documents of a mixture that carries ``columns``, one row for each draw; cut ones keep their first words."""
    draws = mixed.filter("taken > 0").withColumn("_draw", F.explode("draws"))
    text = F.col(f"`{text_column}`")
    # Split where a word ends, so that each part is a word with the white space before it.
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first_words = F.array_join(F.slice(parts, F.lit(1), F.col("_draw.taken").cast("int")), "")
    cut = F.when(F.col("_draw.taken") < F.col("size"), first_words).otherwise(text)
    return draws.select(*[cut.alias(c) if c == text_column else F.col(f"`{c}`") for c in columns])
