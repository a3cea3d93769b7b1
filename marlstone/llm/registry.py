"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import anisotropic, byte_bpe, jaccard_join, packing, page_diff, png_media, substring_dedup, url_trust
from marlstone.llm import line_dedup as lines
from marlstone.llm.quality import quality_scores
from marlstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents: doc_id, held_out, score, predicted."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: page_id, url, text, n_chars."""
    return page_diff.main_text(table(spark, sf_dir, "pages")).drop("n_shared")


def op3_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages: page_id, host, path, rule, verdict."""
    return url_trust.url_verdicts(table(spark, sf_dir, "pages"))


def op4_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as PNG and read back: sizes, digests and cosine hash."""
    return png_media.media_features(png_media.to_media(table(spark, sf_dir, "documents")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages: doc_id, text, cut_chars."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), offsets=False))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: doc_id, class_id, n_links, n_texts, class_size."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated chunks of lines: doc_id, text, n_removed."""
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return anisotropic.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, one row per piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_page_diff": op2_page_diff,
    "op3_url_trust": op3_url_trust,
    "op4_png": op4_png,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_anisotropic": op9_anisotropic,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_page_diff": page_diff.oracle_sql(),
    "op3_url_trust": url_trust.oracle_sql(),
    "op7_jaccard_join": jaccard_join.oracle_sql(),
    "op8_line_dedup": lines.oracle_sql(),
}
