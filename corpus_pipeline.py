"""A corpus pipeline: documents in, a mix of clean documents out.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. Stages return the columns of
``documents``; the last adds ``copies``, how often the mix takes the document, and the sizes behind it.
``n_chars`` follows the text. Rows with nulls, empty texts and equal ids are borne as the operators say.
Further columns stay as they are, whatever their names: operators see them under free names only, and an
added column whose name is taken gets underscores.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.decontamination import decontaminated
from tablewarden.llm.mixing import document_sizes, place_of, thresholds, word_count
from tablewarden.llm.near_duplicates import near_duplicates
from tablewarden.llm.quality import kept_rows, quality_rules
from tablewarden.llm.secrets import redacted, secret_spans
from tablewarden.llm.tables import free_name, staged, table
from tablewarden.sources.scratch import remove_scratch, scratch_copies

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """The stage, with columns that are not those of documents under free names while it runs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: c if c in DOCUMENT else f"user_column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*hidden.values()), sf_dir)
        shown = {name: c for c, name in hidden.items()}
        return out.toDF(*[shown[name] if name in shown else free_name(docs, name) for name in out.columns])

    return run


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The named columns, ``text`` taken from another one and its length counted again."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


@apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are too frequent on their host."""
    return _with_text(kept_rows(quality_rules(docs)), docs.columns, "clean_text")


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; of rows that repeat id and text one stays."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("words"))
    found = staged(near_duplicates(docs.select(key.alias("key"), "text"), key="key"), "near-dedup")
    removed = staged(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "near-removed")
    keyed = docs.withColumn("near_key_", key)
    kept = keyed.join(removed, F.col("near_key_") == F.col("gone"), "left_anti")
    repeated = staged(found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "near-repeated")
    if not repeated.isEmpty():
        same = F.col("near_key_") == F.col("again")
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["near_key_"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, unchanged."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


@apart
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return _with_text(redacted(secret_spans(docs)), docs.columns, "text")


@apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes once or twice."""
    edges = thresholds(staged(document_sizes(docs), "mix-sizes")).withColumnRenamed("source", "mix_source")
    copies = F.col("whole") + (place_of(F.col("doc_id"), F.col("text")) < F.col("edge")).cast("long")
    return (
        docs.join(edges, docs["source"].eqNullSafe(edges["mix_source"]))
        .withColumn("copies", F.least(copies, F.lit(2)))
        .where("copies > 0")
        .withColumn("size", word_count(F.col("text")))
        .select(*docs.columns, "size", "source_size", "target", "copies")
    )


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("mixing", mixing),
]

#: Shingle signatures and the index have no SQL counterpart; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = scratch_copies(spark)
        own = stage(spark, docs, sf_dir)
        used = [path for path in scratch_copies(spark) if path not in before]
        docs = staged(own, f"pipeline-{name}")
        # What the stage wrote on its way is not needed any more; its result is.
        remove_scratch(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)
