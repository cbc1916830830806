"""The checked queries of the operators here: one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import alignment, ann, fingerprints, html, langid, lm, mixing, neardup, negatives, packing, quality, urls, warc
from hitloom.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
CRAWL_DATE = "2024-01-01T00:00:00Z"

# The URL rules of the query, longest wins.
RULES = (
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_RECORD = "urn:hitloom:page:"


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    pages = _read(spark, sf_dir, "pages").select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    folder = scratch_path(spark, "warc")
    marked = warc.mark_revisits(pages, "page_id", "payload")
    records = marked.select(
        "record_type",
        F.concat(F.lit(_RECORD), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.lit(CRAWL_DATE).alias("date"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit(_RECORD), F.col("refers_to").cast("string")).alias("refers_to"),
        "payload",
    )
    manifest = warc.stored_manifest(spark, warc.write_archives(records, f"{folder}/archives"), f"{folder}/manifest")
    read = warc.read_archives(manifest, with_payload=False)

    def page(column: str):
        number = F.regexp_extract(column, rf"^{_RECORD}(-?\d+)$", 1)
        return F.when(number != "", number).cast("long")

    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, _read(spark, sf_dir, "documents"), scratch_path(spark, "mix"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on documents that aren't held out, applied to all."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    taught = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    model = langid.fit(taught)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(_read(spark, sf_dir, "pages"), scratch_path(spark, "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path()))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.with_edits(spark, docs, scratch_path(spark, "fingerprints"))


@query
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_query = F.col("vec_id") % 20 == 0
    return ann.nearest(spark, _read(spark, sf_dir, "embeddings"), scratch_path(spark, "ann"), is_query)


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.find(spark, docs, scratch_path(spark, "neardup"), size=2)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, every seventh label moved on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = _read(spark, sf_dir, "embeddings")
    return negatives.mine(spark, vectors, scratch_path(spark, "negatives"), F.col("vec_id") % 100 == 0, label=moved)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by both tokenizers, aligned, and the counts of the id pairs that it links."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.overlaps(spark, docs, scratch_path(spark, "alignment"), tokenizer_path(), tokenizer_path(PIECES))


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, against references from all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs.select("doc_id", "text"), quality.fit(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
