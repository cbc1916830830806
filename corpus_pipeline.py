"""A training corpus from documents: languages, near-duplicates, mixing and packing, stage by stage.

Each stage takes what the one before kept, stored as Parquet and read again. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.llm import langid, mixing, neardup, packing
from hitloom.llm.queries import held_out, packed_digest, tokenizer_path
from hitloom.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A language that scores hardly more than chance isn't identified.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters, or with no clear language, go."""
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    named = docs.select(*[F.col(c).alias(f"doc_{c}") for c in docs.columns])
    found = langid.identify(named, model, text_column="doc_text")
    sure = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return sure.select(*[F.col(f"doc_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows without an id stay, and so do
    texts of one id that are no near-duplicates."""
    found = neardup.find(spark, docs, scratch_path(spark, "pipeline-neardup"), keys=True)
    kept = found.filter("kept and doc_id is not null").groupBy("doc_id", "set_key").agg(F.min("text_key").alias("text_key"))
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64(*docs.columns)))
    single = keyed.join(kept.select("doc_id", "text_key"), ["doc_id", "text_key"]).withColumn("_first", first).filter("_first = 1")
    return single.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's draws, each a document; one that a target cuts short keeps its first words."""
    mixed = mixing.mix(spark, docs, scratch_path(spark, "pipeline-mix"), carry=docs.columns)
    drawn = mixing.drawn_documents(mixed, "text", docs.columns)
    return drawn.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# A trained model, sampling and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
