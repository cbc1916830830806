"""Hard negatives by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions. For an anchor and a vector, each reference
bounds the angle between them by the triangle inequality: it is at least the difference of their angles to the reference, and at
most the sum (or what is left of a full turn). The tightest bounds give an interval of cosines; times both norms, and widened by
more than rounding can take, it bounds the score. A first pass finds each anchor's positives, scoring vectors of its label in order of
their upper bounds until none can enter; a second pass scores those of other labels whose interval meets one of the
anchor's windows. Scores are integer inner products. Anchors meet all vectors in blocks, in tasks that hold one block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The bound of the sample that reference directions are fitted on, and their number.
SAMPLE = 2048
REFERENCES = 32
_ROUNDS = 5
_SEED = 11

# Rows of vectors, and of anchors, that a task holds.
BLOCK = 8192

# A component x counts as floor(SCALE * x).
SCALE = 256

# Angles are stored as 32-bit floats, whose error and that of the cosine under them stay below a third of this. Products
# of norms are relatively right to many more places than SCORE_SLACK.
ANGLE_SLACK = 1e-6
SCORE_SLACK = 1e-9

_LEAST_LONG, _MOST_LONG = -(2**63), 2**63 - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` (doubles), one row for each id.

    Rows take no part if the id, label or vector is null, or a component null or not finite. Equal rows count once; of different
    rows under one id, the one with the smallest (vector, label) counts. Zero and empty vectors take part: they score 0.
    """
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        label.alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"),
    ).filter("vec_id is not null and label is not null and vector is not null")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("row")).select("vec_id", "row.label", "row.vector")


def integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of all components, as doubles; infinite where only Python's integers can hold it."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * SCALE)


def _exact(vector: np.ndarray) -> list[int]:
    return [int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in vector.tolist()]


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norms of integer vectors, infinite where a double can't hold one, and the vectors at length 1 (0 if zero)."""
    most = np.abs(vectors).max(axis=1, initial=0)
    with np.errstate(all="ignore"):
        part = vectors / np.where(most > 0, most, 1)[:, None]
        norms = np.sqrt((part**2).sum(axis=1))
        unit = part / np.where(norms > 0, norms, 1)[:, None]
        return norms * most, np.where(np.isfinite(unit), unit, 0)


def references_of(rows: DataFrame) -> np.ndarray:
    """Reference directions: centres of a bounded sample, for vectors of the length that is commonest there."""
    sampled = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    lengths = pd.Series([len(v) for v in sampled]).value_counts()
    common = max(lengths.index[lengths == lengths.max()], default=0)
    if not common:
        return np.zeros((0, 0))
    _, units = directions(integers(np.array([v for v in sampled if len(v) == common], dtype=np.float64)))
    units = np.unique(units[(units != 0).any(axis=1)], axis=0)
    if not len(units):
        return np.zeros((0, common))
    rng = np.random.default_rng(_SEED)
    centres = units[rng.permutation(len(units))[:REFERENCES]]
    for _ in range(_ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        norms, moved = directions(sums)
        centres = np.where((norms > 0)[:, None], moved, centres)
    return centres


def represent(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``length``, ``vector`` (packed doubles), ``norm`` of its integers, and ``angles`` to the references."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], []]
            for vector in batch.column(2).to_pylist():
                values = np.array(vector, dtype=np.float64)
                columns[0].append(values.tobytes())
                norm, unit = directions(integers(values[None]))
                columns[1].append(float(norm[0]))
                same = references.shape[1] == len(values) and len(references)
                cosines = references @ unit[0] if same else np.zeros(0)
                columns[2].append(np.arccos(np.clip(cosines, -1, 1)).astype("<f4").tobytes())
            lengths = pa.array([len(v) // 8 for v in columns[0]], pa.int32())
            arrays = [batch.column(0), batch.column(1), lengths, pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(columns[2], pa.binary())], names=["vec_id", "label", "length", "vector", "norm", "angles"]
            )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, length int, vector binary, norm double, angles binary")


def score_bounds(angles: np.ndarray, norms: np.ndarray, own_angles: np.ndarray, own_norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that an anchor's integer scores with vectors are neither below nor above."""
    least, most = np.zeros(len(norms)), np.full(len(norms), np.pi)
    if angles.shape[1]:
        least = np.abs(angles - own_angles).max(axis=1).astype(np.float64)
        both = angles + own_angles
        most = np.minimum(both, 2 * np.pi - both).min(axis=1).astype(np.float64)
    with np.errstate(all="ignore"):
        scale = norms * own_norm
        room = 1 + scale * SCORE_SLACK
        low = scale * np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) - room
        high = scale * np.cos(np.maximum(least - ANGLE_SLACK, 0)) + room
    known = np.isfinite(scale)
    # Scores end at the range of a long, and so do their bounds.
    return np.minimum(np.where(known, low, -np.inf), _MOST_LONG), np.maximum(np.where(known, high, np.inf), _LEAST_LONG)


class Block:
    """A block of vectors: ids, labels, norms, angles, and exact scores of any of them with an anchor."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("vec_id", kind="stable")
        self.ids = rows["vec_id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        self.norms = rows["norm"].to_numpy()
        count = len(rows)
        self.angles = np.frombuffer(b"".join(rows["angles"]), dtype="<f4").reshape(count, -1) if count else np.zeros((0, 0))
        self.vectors = np.frombuffer(b"".join(rows["vector"]), dtype=np.float64).reshape(count, -1) if count else np.zeros((0, 0))
        values = integers(self.vectors)
        # Sums of products of components below this stay within a long.
        limit = 2 ** ((62 - max(1, values.shape[1]).bit_length()) // 2)
        self.wide = (np.abs(values) >= limit).any(axis=1)
        self.values = np.where(self.wide[:, None], 0, values).astype(np.int64)

    def scores(self, rows: np.ndarray, other: Block, at: int) -> np.ndarray:
        """Integer inner products of ``rows`` with row ``at`` of ``other``; beyond a long, the nearest long."""
        if other.wide[at]:
            found, slow = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        else:
            found, slow = self.values[rows] @ other.values[at], np.flatnonzero(self.wide[rows])
        if len(slow):
            anchor = _exact(other.vectors[at])
            for place in slow:
                score = sum(x * y for x, y in zip(anchor, _exact(self.vectors[rows[place]])))
                found[place] = min(max(score, _LEAST_LONG), _MOST_LONG)
        return found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids; ``ids`` ascend."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    # The complement of a long turns the order round without overflow.
    return near[np.argsort(~scores[near], kind="stable")[:k]]


def _find_positives(k: int):
    """Each anchor of a block against the vectors of its label in another."""

    def search(_key: tuple, anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        left, right = Block(anchors), Block(vectors)
        found = []
        for at in range(len(left.ids)):
            own = np.flatnonzero((right.labels == left.labels[at]) & (right.ids != left.ids[at]))
            if not len(own):
                continue
            _, high = score_bounds(right.angles[own], right.norms[own], left.angles[at], left.norms[at])
            first = np.sort(np.argsort(-high, kind="stable")[: 4 * k])
            scores = right.scores(own[first], left, at)
            if len(first) < len(own):
                enough = np.partition(scores, len(scores) - k)[len(scores) - k]
                open_ = high >= float(enough)
                open_[first] = True
                first = np.flatnonzero(open_)
                scores = right.scores(own[first], left, at)
            best = _best(right.ids[own[first]], scores, k)
            found.append((np.full(len(best), left.ids[at]), right.ids[own[first[best]]], scores[best]))
        return _frame(("anchor_id", "positive_id", "positive_score"), found)

    return search


def _find_negatives(k: int, share: tuple[int, int]):
    """Each anchor of a block, with its positives, against vectors of other labels in another block."""
    part, whole = share

    def search(_key: tuple, anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        anchors = anchors.sort_values("vec_id", kind="stable")
        left, right = Block(anchors), Block(vectors)
        found = []
        for at, positives in enumerate(anchors["positives"]):
            windows = [(int(p["positive_id"]), -(-part * int(p["positive_score"]) // whole), int(p["positive_score"])) for p in positives]
            windows = [w for w in windows if w[1] <= w[2]]
            if not windows or not len(right.ids):
                continue
            low, high = score_bounds(right.angles, right.norms, left.angles[at], left.norms[at])
            meets = np.zeros(len(right.ids), dtype=bool)
            for _, least, most in windows:
                meets |= (high >= least) & (low <= most)
            rows = np.flatnonzero(meets & (right.labels != left.labels[at]))
            scores = right.scores(rows, left, at)
            for positive, least, most in windows:
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                best = inside[_best(right.ids[rows[inside]], scores[inside], k)]
                n = len(best)
                found.append((np.full(n, left.ids[at]), np.full(n, positive), np.full(n, most), right.ids[rows[best]], scores[best]))
        return _frame(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), found)

    return search


def _frame(names: tuple[str, ...], parts: list[tuple]) -> pd.DataFrame:
    none = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({name: np.concatenate([none, *(p[i] for p in parts)]) for i, name in enumerate(names)})


def _meet(anchors: DataFrame, vectors: DataFrame, blocks: dict[int, tuple[int, int]], search, schema: str) -> DataFrame:
    """Every block of anchors with every block of vectors of the same length. ``blocks`` has their numbers by length."""

    def number(side: int) -> Column:
        return F.create_map(*[F.lit(x) for length, n in blocks.items() for x in (length, n[side])])[F.col("length")]

    def own(side: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), number(side)).cast("int")

    def every(side: int) -> Column:
        return F.explode(F.sequence(F.lit(0), number(side) - 1))

    left = anchors.select("*", own(0).alias("anchor_block")).select("*", every(1).alias("vector_block"))
    right = vectors.select("*", own(1).alias("vector_block")).select("*", every(0).alias("anchor_block"))
    keys = ["length", "anchor_block", "vector_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def mine(
    spark: SparkSession, vectors: DataFrame, folder: str, is_anchor, id_column: str = "vec_id", vector_column: str = "embedding",
    label: Column | str = "label", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of every anchor and positive.

    ``is_anchor`` is a condition on ``vec_id``. An anchor's positives are its ``positives`` highest scoring other rows of the same label; for
    each, the first ``negatives`` rows of other labels whose score is at most the positive's and at least ``share`` of it (a fraction of
    integers) are returned, highest first. Ties go to smaller ids. A positive with no such row, so any with a negative score, gives none.
    What takes no part, and how repeated ids count, is said at :func:`usable`; vectors of different length never meet; an empty table, or one
    without anchors, gives no rows. ``folder``, shared by all executors, takes the represented vectors and the positives.
    """
    rows = usable(vectors, id_column, vector_column, F.col(f"`{label}`") if isinstance(label, str) else label)
    rows.write.parquet(f"{folder}/vectors")
    rows = spark.read.parquet(f"{folder}/vectors")
    represent(rows, references_of(rows)).write.parquet(f"{folder}/angles")
    stored = spark.read.parquet(f"{folder}/angles")
    anchors = spark.read.parquet(f"{folder}/angles").filter(is_anchor)
    # One row for each length of vectors.
    sizes = stored.groupBy("length").agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors")).collect()
    blocks = {r["length"]: (-(-r["anchors"] // BLOCK), -(-r["n"] // BLOCK)) for r in sizes if r["anchors"]}
    if not blocks:
        return spark.createDataFrame([], RESULT)
    stored = stored.filter(F.col("length").isin(list(blocks)))

    def first(df: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = _meet(anchors, stored, blocks, _find_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    near.write.parquet(f"{folder}/positives")
    near = spark.read.parquet(f"{folder}/positives")
    asking = anchors.join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = _meet(asking, stored, blocks, _find_negatives(negatives, share), schema)
    ranked = first(met, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
