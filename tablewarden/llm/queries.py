"""The corpus queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clusters import centroid_clusters
from .decontamination import decontaminated
from .html_text import page_texts
from .language_id import Fit, fitted, languages, training_rows
from .language_model import language_model_scores
from .licences import license_scans
from .mixing import document_sizes, mixed_sources
from .near_duplicates import near_duplicates
from .paragraphs import repeated_paragraphs
from .quality import quality_rules
from .secrets import count_of, secret_spans, spans_text
from .spelling import spelling_variants
from .tables import staged, table
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary that token counts use unless they are given the path of another.
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        count_of("base_spans", 0).alias("n_assign"),
        count_of("base_spans", 1).alias("n_access"),
        count_of("base_spans", 2).alias("n_hex"),
        F.sha2(spans_text("base_spans"), 256).alias("base_sha256"),
        spans_text("all_spans").alias("spans"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminated(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        "spans",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_removed_words",
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str, fit: Fit = Fit()) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fitted(*training_rows(docs.where(fold != 1), fit), fit)
    scored = languages(docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model)
    return scored.drop("text")


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts(docs, vocabulary, budget=TOKEN_LIMIT)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
        "fit_chars",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sizes = staged(document_sizes(docs), "mix-sizes")
    return mixed_sources(sizes).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": op1_secrets,
        "op2_decontamination": op2_decontamination,
        "op3_quality": op3_quality,
        "op4_html_text": op4_html_text,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_language_id": op6_language_id,
        "op7_token_counts": op7_token_counts,
        "op8_mixing": op8_mixing,
        "op9_paragraphs": op9_paragraphs,
        "op10_language_model": op10_language_model,
        "op11_centroids": op11_centroids,
        "op12_licenses": op12_licenses,
        "op13_spelling": op13_spelling,
    }
