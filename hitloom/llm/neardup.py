"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, and exact verification.

Each register holds the minimum of one hash of a document's shingles as a count of leading zeros and some
mantissa bits. Documents whose sets are equal form a class, and one document of each goes on. Bands of registers
file the classes into buckets. First, all members of a bucket are paired with one of them, another in each
band, so pairs grow with the bucket and not with its square; pairs pass an estimate that allows for chance collisions of
registers and then a comparison of full sets. That ties most groups together. Buckets in which more than one component still
meets are then compared member by member, inside tasks that hold a block of a bucket at a time: on registers,
and then on 32 bits of each shingle, which can only overstate what they share. Of pairs that
pass, those come out that tie components not yet tied in that block, and full sets are compared again. If one of them fails, which takes
two shingles with equal bits, all pairs that pass come out instead. So no pair that shares a bucket is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitloom.llm.components import components
from hitloom.llm.text import Words, mix, shingle_sets, slices
from hitloom.operators.lookups import skew_proof_lookup

SHINGLE = 5
PERCENT = 80

# A pair at the threshold shares no band once in 300,000 times.
BAND_ROWS = 5
BANDS = 32
REGISTERS = BAND_ROWS * BANDS
MANTISSA = 10

# Sets of at most so many shingles are also kept as the low 32 bits of each. Texts that are mostly one shared passage have
# such sets, and come close to the threshold in great number. Larger ones are worked out where they are needed.
SMALL_SET = 256

# Members of a bucket that are compared with each other in one task at a time, and their shingles.
BLOCK = 2000
BLOCK_SHINGLES = 4_000_000

# Estimates may fall short of the threshold by so many standard errors before a pair is given up.
SLACK = 5

_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_CHUNK = 1 << 16


def registers(sets: Words) -> np.ndarray:
    """The registers of each non-empty set: leading zeros above ``MANTISSA`` bits of what follows the first one."""
    full = np.flatnonzero(np.diff(sets.bounds))
    minima = np.zeros((REGISTERS, len(full)), dtype=np.uint32)
    firsts = sets.bounds[full]
    low = (sets.hashes >> np.uint64(32)).astype(np.uint32)
    start = 0
    while start < len(full):
        end = max(start + 1, int(np.searchsorted(firsts, firsts[start] + _CHUNK)))
        stop = firsts[end] if end < len(full) else len(low)
        values, heads = low[firsts[start] : stop], firsts[start:end] - firsts[start]
        for i in range(REGISTERS):
            minima[i, start:end] = np.minimum.reduceat((values ^ _XOR[i]) * _ODD[i], heads)
        start = end
    fraction, exponent = np.frexp(minima.T.astype(np.float64))
    codes = ((32 - exponent) << MANTISSA) + ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)
    codes[minima.T == 0] = 33 << MANTISSA
    found = np.zeros((len(sets), REGISTERS), dtype="<u2")
    found[full] = codes
    return found


def set_keys(sets: Words) -> list[str]:
    """A 128-bit key for each set, the same for equal sets."""
    full = np.flatnonzero(np.diff(sets.bounds))
    keys = np.zeros((len(sets), 2), dtype=np.uint64)
    if len(full):
        for i, salt in enumerate((3, 5)):
            keys[full, i] = np.add.reduceat(mix(sets.hashes * np.uint64(2 * salt + 1) + np.uint64(salt)), sets.bounds[full])
    return [f"{a:016x}{b:016x}" for a, b in keys.tolist()]


def low_sets(sets: Words) -> list[bytes]:
    """The sorted low bits of each small set; nothing of a large one."""
    low = (sets.hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
    bounds = sets.bounds.tolist()
    return [np.sort(low[a:b]).tobytes() if b - a <= SMALL_SET else b"" for a, b in zip(bounds[:-1], bounds[1:])]


def shared_low(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """At most so many shingles of a small set are in each of the others."""
    sizes = np.array([len(o) for o in others])
    values = np.concatenate(others)
    places = np.minimum(np.searchsorted(one, values), len(one) - 1)
    return np.add.reduceat(one[places] == values, np.cumsum(sizes) - sizes, dtype=np.int64)


def _structs(columns: list, schema: T.StructType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], names=arrow.names)


_SIGNED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("registers", T.BinaryType()),
        T.StructField("low", T.BinaryType()),
    ]
)
_SET = T.StructType([T.StructField("key", T.StringType()), T.StructField("shingles", T.BinaryType())])


def _signer(size: int):
    @F.arrow_udf(_SIGNED)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            columns: list[list] = [[], [], [], []]
            for part in slices(column):
                sets = shingle_sets(part, size)
                columns[3] += low_sets(sets)
                columns[0] += np.diff(sets.bounds).tolist()
                columns[1] += set_keys(sets)
                columns[2] += [row.tobytes() for row in registers(sets)]
            yield _structs(columns, _SIGNED)

    return sign


def _setter(size: int):
    @F.arrow_udf(_SET)
    def to_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            columns: list[list] = [[], []]
            for part in slices(column):
                sets = shingle_sets(part, size)
                columns[0] += set_keys(sets)
                columns[1] += [sets.hashes[a:b].tobytes() for a, b in zip(sets.bounds[:-1], sets.bounds[1:])]
            yield _structs(columns, _SET)

    return to_set


@F.arrow_udf(T.BinaryType())
def _low_bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sorted low bits of each set."""
    for column in batches:
        sets = (np.frombuffer(x.as_buffer(), dtype="<u8") for x in column)
        yield pa.array([np.sort(x.astype("<u4")).tobytes() for x in sets], pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _band_keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        if not len(column):
            yield pa.array([], pa.list_(pa.int64()))
            continue
        rows = np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), BANDS, BAND_ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(column), BANDS))
        for i in range(BAND_ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
        yield pa.ListArray.from_arrays(
            pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1).view(np.int64))
        )


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard likeness from registers, less the share of them that sets of ``n`` and ``m`` shingles make equal by chance."""
    # Fixed value: the limit of the chance that two unlike minima of equally large sets agree, times 2**MANTISSA.
    chance = 0.169919487159739 / (1 << MANTISSA) * 4 * n * m / np.maximum(n + m, 1.0) ** 2
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


@F.arrow_udf(T.DoubleType())
def _estimates(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b, n, m in batches:
        codes = [np.frombuffer(b"".join(x.to_pylist()), dtype="<u2").reshape(len(x), REGISTERS) for x in (a, b)]
        yield pa.array(estimate(*codes, n.to_numpy(False).astype(float), m.to_numpy(False).astype(float)))


@F.arrow_udf(T.LongType())
def _shared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """How many shingles two sorted sets share."""
    for a, b in batches:
        found = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
            both = np.sort(np.concatenate([x, y]), kind="stable")
            found.append(int(np.count_nonzero(both[1:] == both[:-1])))
        yield pa.array(found, pa.int64())


def _block_pairs(least: float, percent: int, every: bool):
    """For rows sorted by bucket and pair of blocks: pairs of members that may be near enough and have different labels.

    All of them, or else as many as tie the same labels: labels that a pair has tied are one from then on.
    """

    def pairs_of(ids, labels, sizes, codes, low, blocks, same: bool) -> list[tuple]:
        found = []
        labels = labels.copy()
        for k in range(len(ids)):
            if same:
                others = np.arange(k + 1, len(ids))
            else:
                others = np.flatnonzero(blocks > blocks[k])
            others = others[labels[others] != labels[k]]
            small, large = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
            others = others[100 * small >= percent * large]
            if len(others):
                n = np.full(len(others), float(sizes[k]))
                others = others[estimate(codes[others], codes[k][None, :], n, sizes[others].astype(float)) >= least]
            if len(others):
                shared = shared_low(low[k], [low[o] for o in others])
                others = others[100 * shared >= percent * (sizes[others] + sizes[k] - shared)]
            if len(others) and not every:
                tied, firsts = np.unique(labels[others], return_index=True)
                others = others[firsts]
                labels[np.isin(labels, tied)] = labels[k]
            found += [(min(ids[k], ids[o]), max(ids[k], ids[o]), k, o) for o in others]
        return [(a, b, *((sizes[k], sizes[o]) if ids[k] == a else (sizes[o], sizes[k]))) for a, b, k, o in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            codes = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            low = [np.frombuffer(x, dtype="<u4") for x in batch.column(8).to_pylist()]
            keys = np.stack(columns[:3])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            result = []
            for start, end in zip(edges[:-1], edges[1:]):
                part = ([c[start:end] for c in columns], codes[start:end], low[start:end])
                if held and (held[0][0][0][0], held[0][0][1][0], held[0][0][2][0]) != tuple(keys[:, start]):
                    result += whole(held)
                    held = []
                held.append(part)
            yield rows(result)
        yield rows(whole(held) if held else [])

    def whole(held: list) -> list[tuple]:
        band, first, second, ids, labels, sizes, blocks = [np.concatenate([part[0][i] for part in held]) for i in range(7)]
        low = [x for part in held for x in part[2]]
        return pairs_of(ids, labels, sizes, np.concatenate([part[1] for part in held]), low, blocks, first[0] == second[0])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in range(4)], names=["a", "b", "n_a", "n_b"])

    return run


class _Search:
    """The tables of one search, under one folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame, folder: str, size: int, percent: int):
        self.spark, self.docs, self.folder, self.size, self.percent = spark, docs, folder, size, percent
        share = percent / 100
        self.least = share - SLACK * (share * (1 - share) / REGISTERS) ** 0.5

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def likely(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of pairs (``a``, ``b``) of classes those whose registers are near enough."""
        side = {s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}")) for s in "ab"}
        both = pairs.join(side["b"], "b").join(side["a"], "a").withColumn("_estimate", _estimates("r_a", "r_b", "n_a", "n_b"))
        return both.filter(F.col("_estimate") >= self.least).select("a", "b", "n_a", "n_b")

    def _sets(self, wanted: DataFrame, classes: DataFrame) -> DataFrame:
        """The sorted ``shingles`` of the classes ``wanted`` (``_id``), from the text of one of their documents."""
        doc = F.col("doc" if "doc" in classes.columns else "id").alias("_doc")
        wanted = wanted.join(classes.select(F.col("id").alias("_id"), doc, F.col("key").alias("_key")), "_id")
        texts = self.docs.join(wanted, F.col("id") == F.col("_doc")).withColumn("_set", _setter(self.size)("text"))
        return texts.filter(F.col("_set.key") == F.col("_key")).groupBy("_id").agg(F.min("_set.shingles").alias("shingles"))

    def verified(self, likely: DataFrame, classes: DataFrame, step: int) -> DataFrame:
        """Of likely pairs those whose full sets are near enough."""
        wanted = likely.select(F.col("a").alias("_id")).unionByName(likely.select(F.col("b").alias("_id"))).distinct()
        texts = self.stored(self._sets(wanted, classes), f"sets{step}")
        other = {s: texts.select(F.col("_id").alias(s), F.col("shingles").alias(f"s_{s}")) for s in "ab"}
        compared = likely.join(other["b"], "b").join(other["a"], "a").withColumn("_shared", _shared("s_a", "s_b"))
        union = F.col("n_a") + F.col("n_b") - F.col("_shared")
        near = compared.filter(100 * F.col("_shared") >= self.percent * union).select("a", "b")
        return self.stored(near, f"links{step}")

    def run(self) -> DataFrame:
        signed = self.docs.select("id", F.xxhash64("text").alias("text_key"), _signer(self.size)("text").alias("_s"))
        signed = self.stored(signed.select("id", "text_key", "_s.n", "_s.key", "_s.registers", "_s.low"), "signed")
        # Classes go by a hash of their key, as an id may stand in several; ``doc`` is the smallest id of a class.
        classes = signed.filter("n > 0 and id is not null").groupBy("key").agg(
            F.xxhash64("key").alias("id"), F.min("id").alias("doc"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("low").alias("low"),
            F.count("*").alias("copies"),
        )
        classes = self.stored(classes, "classes")
        # Different sets this small can't be near enough: dropping one shingle is already too much.
        bands = classes.filter((100 - self.percent) * F.col("n") >= self.percent).select(
            "id", F.explode(_band_keys("registers")).alias("band")
        )
        # The smallest id after some of its bits are turned over, as the band's key says: another member in each band.
        turned = F.col("id").bitwiseXOR(F.col("band"))
        buckets = bands.groupBy("band").agg(F.min(turned).alias("_turned"), F.count("*").alias("members"))
        # Stored, so that the join has an exchange on either side and a bucket with very many members is split.
        buckets = self.stored(buckets.filter("members > 1"), "buckets")
        members = bands.join(buckets, "band").select("band", "id", F.col("_turned").bitwiseXOR(F.col("band")).alias("centre"), "members")
        members = self.stored(members.filter("id <> centre"), "members")
        pairs = members.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
        links = self.verified(self.stored(self.likely(pairs, classes), "likely0"), classes, 0)
        labels = components(self.spark, links, f"{self.folder}/components0")
        meeting = members.filter("members > 2").select("band", "id")
        rest = self.stored(self._meeting(meeting, labels, classes), "likely1")
        if not rest.isEmpty():
            more = self.verified(rest, classes, 1)
            if more.count() < rest.count():
                # What failed may have stood for pairs that don't.
                rest = self.stored(self._meeting(meeting, labels, classes, every=True), "likely2")
                more = self.verified(rest, classes, 2)
            if not more.isEmpty():
                labels = components(self.spark, links.unionByName(more), f"{self.folder}/components1")
        named = classes.join(labels, "id", "left").select("key", "id", "doc", F.coalesce("component", "id").alias("component"), "copies")
        named = self.stored(named, "named")
        heads = named.groupBy("component").agg(F.min(F.struct("doc", "id")).alias("head"), F.count("*").alias("_classes"))
        headed = skew_proof_lookup(named, "component", heads, "component", "head", "_classes", "head", ["id"])
        headed = headed.select("key", F.struct(F.col("head.doc").alias("doc"), (F.col("head.id") == F.col("id")).alias("first")).alias("head"), "copies")
        light = signed.select("id", "text_key", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("key")).alias("key"))
        return skew_proof_lookup(light, "key", headed, "key", "head", "copies", "head", ["id"])

    def _meeting(self, members: DataFrame, labels: DataFrame, classes: DataFrame, every: bool = False) -> DataFrame:
        """Likely pairs of different components inside buckets that more than one of them meets in: every one, or as many as tie
        the same components."""
        step = 2 if every else 1
        labelled = members.join(labels, "id", "left").join(classes.select("id", "n"), "id")
        labelled = self.stored(labelled.select("band", "id", F.coalesce("component", "id").alias("label"), "n"), f"labelled{step}")
        met = labelled.groupBy("band").agg(
            F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_members"), F.sum("n").alias("_shingles")
        )
        blocks = F.greatest(F.ceil(F.col("_members") / BLOCK), F.ceil(F.col("_shingles") / BLOCK_SHINGLES))
        met = met.withColumn("_answer", F.when(F.col("_low") != F.col("_high"), blocks))
        open_ones = skew_proof_lookup(labelled, "band", met, "band", "_answer", "_members", "blocks", ["id"])
        open_ones = self.stored(open_ones.filter("blocks is not null"), f"open{step}")
        meeting = classes.join(open_ones.select("id").distinct(), "id", "left_semi").select("id", "n", "registers", "low")
        large = meeting.filter(F.length("low") == 0).select(F.col("id").alias("_id"))
        bits = self._sets(large, classes).select("_id", _low_bits("shingles").alias("_bits"))
        meeting = meeting.join(bits, F.col("id") == F.col("_id"), "left")
        meeting = self.stored(meeting.select("id", "n", "registers", F.coalesce("_bits", "low").alias("low")), f"meeting{step}")
        dealt = open_ones.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
            "band", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"), "id", "label", "block"
        )
        whole = dealt.join(meeting, "id")
        keys = ["band", "first", "second"]
        ordered = whole.select(*keys, "id", "label", "n", "block", "registers", "low").repartition(*keys).sortWithinPartitions(*keys)
        found = ordered.mapInArrow(_block_pairs(self.least, self.percent, every), "a long, b long, n_a long, n_b long")
        return found.distinct()


def find(
    spark: SparkSession, docs: DataFrame, folder: str, size: int = SHINGLE, percent: int = PERCENT,
    id_column: str = "doc_id", text_column: str = "text", keys: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if their sets of shingles of ``size`` words share at least ``percent`` of their union; a document with fewer
    words has all of them as one shingle. ``component_id`` is the smallest id reachable, and ``kept`` marks that document. A null
    or empty text has no shingles and no links. Ids are integers. Rows with one id and different texts are documents of their own, not
    linked through the id; if several of the smallest id are in one component, those with one set of shingles are kept. A row without
    an id is linked with nothing, its component is null and it is kept. Repeated rows are copies of each other. Other columns are left
    out, and an empty table gives no rows. ``keys`` appends ``text_key``, the row's ``xxhash64`` of the text (a null one as empty), and
    ``set_key``, the same for equal sets. ``folder``, shared by all executors, takes the tables of the search.
    """
    named = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    found = _Search(spark, named, folder, size, percent).run()
    kept = F.coalesce(F.col("head.first") & (F.col("head.doc") == F.col("id")), F.lit(True))
    return found.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("head.doc", "id").alias("component_id"), kept.alias("kept"),
        *([F.col("text_key"), F.col("key").alias("set_key")] if keys else []),
    )
