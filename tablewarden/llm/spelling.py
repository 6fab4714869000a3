"""Spelling variants: words that differ by one letter, found by PartEnum signatures.

A word's letters are a multiset, written as a binary vector with one place per letter and repetition.
One inserted or deleted letter changes one place of it, a replaced letter two. The letters are dealt to
parts; with at most d places changed, all but d parts at least are the same. Every choice of parts that
are left is one exact signature: two of four parts where a letter is replaced, two of three where one is
inserted or deleted. Two words within that distance share a signature in any case.

A signature is made narrower, without losing a pair, by what one edit cannot change: the lengths (equal,
or one apart), and one half of the word. Words meet by an equi-join on signatures, so the size of a
meeting is set by the alphabet and not by the corpus, and pairs are verified by their edit distance.

Words come from whole texts: runs of letters, where one deterministic in 97 loses a letter. They are
counted with map-side aggregation, so a word in a third of all texts reaches its reducer as one row per task.

Defined cases: a null text has no words; a null id is written as the empty text in the number of a run;
repeated rows count as often as they stand there; words are compared by code points, accents included; an
empty table gives no rows. Only id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged

#: Letters of words, besides A-Z, which count as a-z.
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
LETTERS = string.ascii_lowercase + ACCENTED

#: Parts and how many of them one edit can change: by replacing a letter, or inserting or deleting one.
REPLACED = (4, 2)
INSERTED = (3, 1)
#: Roles of a word in a signature: equally long, the shorter one, the longer one.
EQUAL, SHORTER, LONGER = 0, 1, 2


@dataclass(frozen=True)
class Rules:
    """Words have ``least_length`` code points and ``least_count`` occurrences; a form has ``ratio`` times as many."""

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    deleted_one_in: int = 97


def word_counts(df: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words of all texts."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    # Shorter runs cannot become words. The pattern takes whole runs, as a longer one goes on to its end.
    run = f"[a-z{ACCENTED[0]}-{ACCENTED[-1]}]{{{rules.least_length},}}"
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = df.select(name.alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(run), F.lit(0))).alias("run"))
    number = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    shorter = F.expr("concat(left(run, cast(number % length(run) AS int)), substring(run, cast(number % length(run) AS int) + 2))")
    return (
        runs.withColumn("number", number)
        .select(F.when(F.col("number") % rules.deleted_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= rules.least_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= rules.least_count)
    )


def letter_parts(counted: DataFrame, parts: int) -> list[str]:
    """The alphabet dealt to parts of about the same use, by letter counts over all words (one row per letter)."""
    used = counted.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    count = {row["letter"]: row["count"] for row in used}
    held, size = [""] * parts, [0] * parts
    for letter in sorted(LETTERS, key=lambda c: (-count.get(c, 0), c)):
        least = size.index(min(size))
        held[least] += letter
        size[least] += count.get(letter, 0)
    return held


def _projections(sorted_letters: Column, parts: list[str], changed: int) -> list[Column]:
    """The word's letters in every choice of parts that ``changed`` places leave alone."""
    out = []
    for chosen in combinations(range(len(parts)), len(parts) - changed):
        left_out = "".join(parts[p] for p in range(len(parts)) if p not in chosen)
        out.append(F.concat(F.lit(",".join(map(str, chosen)) + ":"), F.translate(sorted_letters, left_out, "")))
    return out


def signatures(counted: DataFrame, role: int, parts: list[str], changed: int) -> DataFrame:
    """``signature``, ``word`` and ``n`` of words in one role; a signature is a 64-bit hash of what has to be equal."""
    rows = counted.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), "")).withColumn("size", F.length("word"))
    longer = F.col("size") + (1 if role == SHORTER else 0)
    middle = F.floor(longer / 2).cast("int")
    # The second half begins one place earlier in the shorter word.
    second = middle + (0 if role == SHORTER else 1)
    halves = (F.substr("word", F.lit(1), middle), F.substr("word", second, F.col("size")))
    kind = F.lit(EQUAL if role == EQUAL else SHORTER)
    made = [
        F.xxhash64(kind, F.lit(which), longer, half, projection)
        for which, half in enumerate(halves)
        for projection in _projections(F.col("letters"), parts, changed)
    ]
    return rows.select(F.explode(F.array(*made)).alias("signature"), "word", "n")


def near_words(counted: DataFrame) -> DataFrame:
    """Pairs of words (``word``, ``n``, ``near``, ``near_n``) that are one edit apart, in both directions."""
    one_edit = F.levenshtein("word", "near", 1) == 1

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.toDF("signature", "near", "near_n"), "signature").where(one_edit)

    equal = signatures(counted, EQUAL, letter_parts(counted, REPLACED[0]), REPLACED[1])
    parts = letter_parts(counted, INSERTED[0])
    shorter, longer = (signatures(counted, role, parts, INSERTED[1]) for role in (SHORTER, LONGER))
    found = met(equal, equal).where("word < near").union(met(shorter, longer))
    pairs = found.select("word", "n", "near", "near_n").distinct()
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.union(back)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of words with a form: where following forms ends.

    Counts at least double with every step, so chains are short; each round follows twice as many steps.
    """
    reached = staged(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = reached.join(further, "root", "left")
        moved = staged(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def spelling_variants(df: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    counted = staged(word_counts(df, rules, key, text), "word-counts")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= rules.ratio * F.col("n")
    judged = counted.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    judged = staged(judged, "word-forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
