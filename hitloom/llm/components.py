"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.operators.lookups import skew_proof_lookup


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_least"), F.count("*").alias("_rows"))
    joined = skew_proof_lookup(both, "a", least, "a", "_least", "_rows", "least", ["b"])
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie the smaller neighbours of each node, and itself, to its smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("_least"), F.count("*").alias("_rows"))
    joined = skew_proof_lookup(edges, "a", least, "a", "_least", "_rows", "least", ["b"])
    others = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Has each node one link at most, to one that has none itself?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for all ids in ``links`` (``a``, ``b``) but the smallest ones.

    Links of a node to itself, repeated ones and those with a null end change nothing. Each round is stored under ``folder``,
    which cuts lineage; rounds grow with the logarithm of the longest chain. A node with very many links
    is spread over tasks.
    """
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    links.filter("a <> b").select(*ends).distinct().write.parquet(f"{folder}/0")
    edges, step = spark.read.parquet(f"{folder}/0"), 0
    while not _is_settled(edges):
        step += 1
        _small_star(_large_star(edges)).write.parquet(f"{folder}/{step}")
        edges = spark.read.parquet(f"{folder}/{step}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
