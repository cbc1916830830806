"""Nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Each vector is represented by its nearest pivots in order, and posted in the
inverted files of the first few. A query visits the files of its own nearest pivots; there, candidates are ranked by the
footrule distance between the two orders, and the best are ranked again by their inner product. A candidate met in
several files counts in that of the query's nearest pivot only. Large files are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The bound of the sample: as many vectors, of which the pivots are the first different ones.
SAMPLE = 1024
PIVOTS = 256

# Pivots in a representation; files that a vector is posted in, and that a query visits.
ORDER = 64
POSTS = 4
VISITS = 64

# Of a file's block, the share that is ranked again, and the least number.
SHARE = 0.2
LEAST = 64

BLOCK = 4096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles), one row for each id, of vectors that can take part, of the commonest length.

    Null ids, null or zero vectors and those with a null or non-finite component take no part. Of several vectors under one id
    the smallest counts; if two lengths are equally common, the larger.
    """
    value = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), value.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    ).filter(finite & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return rows.filter(F.size("vector") == (common["length"] if common else 0))


def pivots_of(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The pivots, as unit vectors, and the largest norm. One component is added so that all vectors have that
    norm; then the largest inner product is the smallest angle."""
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    norm = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    different = list(dict.fromkeys(tuple(row["vector"]) for row in sampled))[:PIVOTS]
    return _lifted(np.array(different), norm), norm


def _lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(norm - (vectors**2).sum(axis=1), 0))
    whole = np.concatenate([vectors, extra[:, None]], axis=1)
    return whole / np.sqrt((whole**2).sum(axis=1, keepdims=True))


def represent(rows: DataFrame, pivots: np.ndarray, norm: float) -> DataFrame:
    """``vec_id``, ``vector`` and, as query and as candidate, the ``ORDER`` nearest pivots in order, as bytes."""
    top = min(ORDER, len(pivots))

    def orders(vectors: np.ndarray) -> list[bytes]:
        near = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :top].astype(np.uint8)
        return [row.tobytes() for row in near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            flat = np.concatenate([values, np.zeros((len(values), 1))], axis=1)
            arrays = [
                batch.column(0),
                pa.array([row.tobytes() for row in values], pa.binary()),
                pa.array(orders(_lifted(values, norm)), pa.binary()),
                pa.array(orders(flat), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vector", "posted", "asked"])

    return rows.mapInArrow(run, "vec_id long, vector binary, posted binary, asked binary")


def _search_block(pivots: int, top: int, wanted: int):
    """Queries against candidates of one block of one inverted file."""

    def search(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if queries.empty or candidates.empty:
            return empty
        pivot = int(key[0])
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids = candidates["vec_id"].to_numpy()
        vectors = np.frombuffer(b"".join(candidates["vector"]), dtype=np.float64).reshape(len(ids), -1)
        orders = np.frombuffer(b"".join(candidates["posted"]), dtype=np.uint8).reshape(len(ids), -1)
        places = np.full((pivots, len(ids)), top, dtype=np.int8)
        places[orders.T, np.arange(len(ids))] = np.arange(top, dtype=np.int8)[:, None]
        own = np.arange(top, dtype=np.int8)[:, None]
        found = []
        for query_id, vector, asked in zip(queries["vec_id"], queries["vector"], queries["asked"]):
            asked = np.frombuffer(asked, dtype=np.uint8)
            nearer = asked[: int(np.flatnonzero(asked == pivot)[0])]
            fresh = ids != query_id
            if len(nearer):
                fresh &= (places[nearer] >= POSTS).all(axis=0)
            here = np.flatnonzero(fresh)
            if not len(here):
                continue
            there = places[asked][:, here]
            footrule = np.abs(there - own).sum(axis=0, dtype=np.int32) + there.sum(axis=0, dtype=np.int32)
            again = max(LEAST, wanted, int(SHARE * len(here)))
            best = here[np.argsort(footrule, kind="stable")[:again]]
            scores = (vectors[best] * np.frombuffer(vector, dtype=np.float64)).sum(axis=1)
            order = np.lexsort((ids[best], -scores))[:wanted]
            found.append((np.full(len(order), query_id), ids[best[order]], scores[order]))
        if not found:
            return empty
        return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("query_id", "vec_id", "score"), zip(*found))})

    return search


def nearest(
    spark: SparkSession, vectors: DataFrame, folder: str, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: for each query the ``k`` nearest vectors found but its own.

    ``is_query`` is a condition on ``vec_id``. ``score`` is the inner product in double precision, and ties go to the smaller id. What takes no
    part, and how repeated ids count, is said at :func:`usable`; an empty table gives no rows. Every vector is posted; the sample
    only chooses pivots. ``folder``, shared by all executors, takes the table of representations.
    """
    rows = usable(vectors, id_column, vector_column)
    rows.write.parquet(f"{folder}/vectors")
    rows = spark.read.parquet(f"{folder}/vectors")
    schema = "query_id long, vec_id long, score double"
    if rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots, norm = pivots_of(rows)
    top = min(ORDER, len(pivots))
    represent(rows, pivots, norm).write.parquet(f"{folder}/orders")
    stored = spark.read.parquet(f"{folder}/orders")

    def pivots_in(column: str, number: int):
        positions = F.array(*[F.lit(i) for i in range(1, min(number, top) + 1)])
        return F.explode(F.transform(positions, lambda i: F.conv(F.hex(F.substring(F.col(column), i, 1)), 16, 10).cast("int")))

    posts = stored.select("vec_id", "vector", "posted", pivots_in("posted", POSTS).alias("pivot"))
    asked = stored.filter(is_query).select("vec_id", "vector", "asked", pivots_in("asked", VISITS).alias("pivot"))
    # One row for each pivot: how many blocks its candidates and its queries make.
    blocks = {
        name: {r["pivot"]: -(-r["n"] // BLOCK) for r in df.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        for name, df in (("posts", posts), ("asked", asked))
    }

    def number_of(name: str):
        found = blocks[name] or {0: 1}
        return F.coalesce(F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[F.col("pivot")], F.lit(1))

    own_block = {name: F.pmod(F.xxhash64("vec_id"), number_of(name)).cast("int") for name in blocks}
    every = {name: F.explode(F.sequence(F.lit(0), number_of(name) - 1)) for name in blocks}
    left = asked.select("*", own_block["asked"].alias("asked_block")).select("*", every["posts"].alias("post_block"))
    right = posts.select("*", own_block["posts"].alias("post_block")).select("*", every["asked"].alias("asked_block"))
    keys = ["pivot", "post_block", "asked_block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search_block(len(pivots), top, k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
