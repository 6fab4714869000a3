"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; per host the distinct documents that hold a line are counted, where
documents with the same text are one. A line above the limit is taken out wherever it stands, and a
document that loses too much is rejected, as are documents that fail the plain rules.

The limit is a number of documents, the same for every host. Lines above it are joined back to the
distinct texts by host, hash and salt, and each text gets the list of its own.

Defined cases: a null text is an empty one (no words, fails); a null host is a host of its own; lines
without a word are neither counted nor removed; repeated rows are judged alike; an empty table gives
no rows. Columns that clash with a result column are replaced by it.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged

BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Parts that a frequent line's texts are dealt to.
SALTS = 16
#: Parts that the rows of one text are dealt to.
COPIES = 4


@dataclass(frozen=True)
class Limits:
    """A text needs ``min_words`` words, at most ``repeated_share`` of them in repeated windows of three.

    A line is above the limit in more than ``line_documents`` documents of its host and, if it is set,
    more than ``line_share`` of them. A document is depleted when it keeps less than ``left_share`` of its words.
    """

    min_words: int = 50
    repeated_share: float = 0.5
    line_documents: int = 10
    line_share: float = 0.0
    left_share: float = 0.5


def word_list(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def normalised_line(line: Column) -> Column:
    """One blank between words, none around them, A-Z as a-z, and every digit as 0."""
    letters = F.translate(line, string.ascii_uppercase + "123456789", string.ascii_lowercase + "000000000")
    return F.btrim(F.regexp_replace(letters, r"[ \t-\r]+", " "))


def line_hash(line: Column) -> Column:
    """Null for a line without a word."""
    plain = normalised_line(line)
    return F.when(plain != "", F.xxhash64(plain))


def repeated_words(df: DataFrame, words: str, n_words: str, result: str) -> DataFrame:
    """Words in windows of three words that the text holds twice or more.

    Every window is one number, its hash above and its place below, so that sorting a text's numbers
    puts equal windows side by side; equal hashes are compared word by word.
    """
    same = " AND ".join(
        ["shiftrightunsigned(k, bits_) = shiftrightunsigned({other}, bits_)"]
        + [f"{words}[(k & mask_) + {i}] = {words}[({{other}} & mask_) + {i}]" for i in range(3)]
    )
    before, behind = same.format(other="windows_[j - 1]"), same.format(other="windows_[j + 1]")
    return (
        df.withColumn("bits_", F.length(F.bin(F.col(n_words))))
        .withColumn("mask_", F.expr("shiftleft(1L, bits_) - 1"))
        .withColumn(
            "windows_",
            F.expr(
                f"CASE WHEN {n_words} < 3 THEN cast(array() AS array<bigint>) ELSE sort_array(transform("
                f"sequence(0L, cast({n_words} - 3 AS bigint)), i -> "
                f"shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), bits_) | i)) END"
            ),
        )
        .withColumn(
            "places_",
            F.expr(
                f"sort_array(filter(transform(windows_, (k, j) -> CASE WHEN (j > 0 AND {before}) "
                f"OR (j + 1 < size(windows_) AND {behind}) THEN k & mask_ END), p -> p IS NOT NULL))"
            ),
        )
        .withColumn(
            result,
            F.expr(
                "aggregate(places_, named_struct('end', 0L, 'n', 0L), (a, p) -> "
                "named_struct('end', p + 3, 'n', a.n + least(3L, p + 3 - a.end)), a -> a.n)"
            ),
        )
        .drop("bits_", "mask_", "windows_", "places_")
    )


def frequent_lines(df: DataFrame, limits: Limits, host: str, text: str) -> DataFrame:
    """``host_``, ``text_``, ``size_`` of texts with lines above the limit, and ``lines_``, the hashes of these."""
    hashes = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_hash), lambda h: h.isNotNull()))
    texts = df.select(F.col(host).alias("host_"), *_text_key(text), hashes.alias("lines_")).dropDuplicates(["host_", "text_", "size_"])
    texts = staged(texts, "line-texts")
    lines = texts.select("host_", "text_", "size_", F.explode("lines_").alias("line_"))
    many = lines.groupBy("host_", "line_").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > limits.line_documents)
    if limits.line_share:
        hosts = texts.groupBy(F.col("host_").alias("of_")).agg(F.count(F.lit(1)).alias("documents_"))
        many = many.join(hosts, F.col("host_").eqNullSafe(F.col("of_"))).where(F.col("n_") > limits.line_share * F.col("documents_"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    above = staged(many.select(F.col("host_").alias("of_"), F.col("line_").alias("above_")), "frequent-lines").withColumn("part_", salts)
    same = F.col("host_").eqNullSafe(F.col("of_")) & (F.col("line_") == F.col("above_")) & (F.pmod("text_", F.lit(SALTS)) == F.col("part_"))
    return staged(lines.join(above, same).groupBy("host_", "text_", "size_").agg(F.collect_list("line_").alias("lines_")), "lines-of-texts")


def _text_key(text: str) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("text_"), F.length(text).alias("size_")


def kept_rows(judged: DataFrame) -> DataFrame:
    """The rows of ``quality_rules`` that are kept.

    A filter on ``kept`` would be moved below the measures and repeat all their expressions, over and
    over; it does not move below a column of row numbers.
    """
    return judged.withColumn("row_", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("row_") >= 0)).drop("row_")


def quality_rules(df: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows with their measures, ``base_failed``, ``kept`` and ``clean_text`` (the text without lines above the limit)."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.withColumn("body_", body)
    found = frequent_lines(docs, limits, host, "body_")
    lines = F.filter(F.split("body_", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    measured = (
        docs.withColumn("words_", word_list(F.col("body_")))
        .withColumn("n_words", F.size("words_").cast("long"))
        .withColumn("word_chars", F.length(F.translate("body_", BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length("body_") - F.length(F.translate("body_", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    )
    measured = repeated_words(measured, "words_", "n_words", "n_repeat_words").drop("words_")
    # Numbers go into the join with a text's lines, so that the text itself does not unless it is asked for.
    measured = (
        measured.withColumn("all_lines_", F.transform(F.split("body_", "\n"), line_hash))
        .withColumn("line_words_", F.transform(F.split("body_", "\n"), lambda line: F.regexp_count(line, F.lit(r"[^ \t-\r]+"))))
        .withColumn("own_text_", F.xxhash64("body_"))
        .withColumn("own_size_", F.length("body_"))
    )
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") > limits.repeated_share * F.col("n_words"))
    # Copies of one text are dealt to salts. The join is a sorted one at every size of the corpus: a list that
    # is broadcast while it is small would hide what a large one costs.
    measured = measured.withColumn("own_part_", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)))
    dealt = found.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).hint("merge")
    joined = measured.join(
        dealt,
        F.col(host).eqNullSafe(F.col("host_"))
        & (F.col("own_text_") == F.col("text_"))
        & (F.col("own_size_") == F.col("size_"))
        & (F.col("own_part_") == F.col("part_")),
        "left",
    )
    is_above = lambda line: F.array_contains("lines_", F.coalesce(line_hash(line), F.lit(0)))
    rest = F.array_join(F.filter(F.split("body_", "\n"), lambda line: ~is_above(line)), "\n")
    counted = F.zip_with("all_lines_", "line_words_", lambda h, n: F.when(F.array_contains("lines_", h), n).otherwise(0))
    removed = F.when(F.col("lines_").isNull(), 0).otherwise(F.aggregate(counted, F.lit(0), lambda a, n: a + n))
    return (
        joined.withColumn("base_failed", failed)
        .withColumn("n_removed_words", removed.cast("long"))
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("n_removed_words") >= limits.left_share * F.col("n_words")))
        .withColumn("clean_text", F.when(F.col("n_removed_words") == 0, F.col("body_")).otherwise(rest))
        .drop("body_", "host_", "lines_", "text_", "size_", "part_", "own_text_", "own_size_", "own_part_", "all_lines_", "line_words_")
    )
