"""Substring deduplication by paragraphs and by passages.

Paragraphs. Texts are cut into their lines; lines with enough words are paragraphs. Paragraphs with the same words
are one class, classes get MinHash bands (three minima a band, sixteen bands, so a pair at similarity
0.75 is missed with probability (1 - 0.75^3)^16 < 2e-4), colliding classes are joined and verified by
exact Jaccard similarity of their five-word shingles, and removals are clustered by components: the
first paragraph of a component stays, by document id and place.

Passages. Every window of fifty words that stands in two documents is found, wherever lines end. Of each
26 neighbouring runs of 25 words, those of one such window, the smallest hash is its mark: equal windows
have equal marks. Rows with the same text are one class, of which one row is worked. Classes with a mark
that another class has send their windows with such marks, classes of several documents all windows; equal
windows in several documents are put together to spans, and every row of a class gets its spans. In the
first document with a window it stays, by document id and place. Spans that a reported paragraph covers are
left out. What a step no longer needs is deleted, its shuffle files too.

What is listed for a class (its marks) is never more than its text holds. Joins on a hash that very many
texts share are split by Spark's adaptive skew join.

Defined cases: null and empty texts have no paragraphs; a passage that repeats only inside one document
is not reported; rows that repeat a document's id count as that document, and each row gets its spans; null
ids come first and count as one document; columns other than key and text are not read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import remove_scratch
from .near_duplicates import Near, near_duplicates
from .tables import shipped, staged
from .texts import mixed, slices, words

#: Paragraphs with fewer words are left alone.
LEAST_WORDS = 40
#: Words of a passage and of the runs that mark it; so many runs neighbour each other in a passage.
PASSAGE, RUN = 50, 25
RUNS = PASSAGE - RUN + 1
#: A line's number has fewer bits than these; with the rank of a document before them it is one number.
LINE_BITS = 31
PARAGRAPH_NEAR = Near(bands=16, rows=3, margin=0.3)


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``id`` (doc_id, line, start, end; in code points) and ``text`` of every paragraph."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    numbers = [F.lit(0).cast("bigint").alias(name) for name in ("line", "start", "end")]
    schema = docs.select(F.struct("doc_id", *numbers).alias("id"), "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, starts, ends, texts = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                at = 0
                for number, line in enumerate((value.as_py() or "").split("\n")):
                    if len(line) >= 2 * least_words - 1 and len(line.encode().split()) >= least_words:
                        rows.append(row)
                        lines.append(number)
                        starts.append(at)
                        ends.append(at + len(line))
                        texts.append(line)
                    at += len(line) + 1
            longs = [pa.array(x, pa.int64()) for x in (lines, starts, ends)]
            of = batch.column(0).take(pa.array(rows, pa.int64()))
            ids = pa.StructArray.from_arrays([of, *longs], names=["doc_id", "line", "start", "end"])
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["id", "text"])

    return shipped(docs).mapInArrow(run, schema)


def _windows(values: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` over ``size`` neighbouring values, for each place that has so many; parts are doubled."""
    out, have, part, length, rest = None, 0, values, 1, size
    while rest:
        if rest & 1:
            n = max(0, len(values) - have - length + 1)
            out, have = (part if out is None else join(out[:n], part[have : have + n])), have + length
        rest >>= 1
        if rest:
            n = max(0, len(part) - length)
            part, length = join(part[:n], part[length : length + n]), length * 2
    return out


def _hashed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _marks(hashes: np.ndarray) -> np.ndarray:
    """The mark of every window of a passage's length."""
    return _windows(_windows(hashes, RUN, _hashed), RUNS, np.minimum)


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first row of each class in the batch; column 0 is the class."""
    _, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
    return batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def text_marks(texts: DataFrame) -> DataFrame:
    """``class``, ``mark``. ``texts``: (class, text); rows of a class have the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            for part in slices(batch.column(1)):
                found = words(part)
                marks = _marks(found.hashes)
                held = [np.unique(marks[lo : max(lo, hi - PASSAGE + 1)]) for lo, hi in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
                of = np.repeat(np.arange(part.first, part.last), [len(x) for x in held])
                ids = batch.column(0).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(held).view(np.int64))], names=["class", "mark"])

    return shipped(texts).mapInArrow(run, texts.select("class", F.lit(0).cast("bigint").alias("mark")).schema)


_PLACE = ("hash", "word", "line", "start", "end")


def marked_windows(texts: DataFrame) -> DataFrame:
    """Windows with a wanted mark, all where ``wanted`` is null: the columns before ``wanted``, ``hash``, and ``word``, ``line``, ``start``, ``end`` (in code points).

    ``texts``: (node, ..., wanted, text); rows of a node have the same text.
    """
    kept = texts.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, batches):
            wanted, text_column = batch.column(len(kept)), batch.column(len(kept) + 1)
            for part in slices(text_column):
                found = words(part)
                marks, hashes = _marks(found.hashes), _windows(found.hashes, PASSAGE, _hashed)
                texts_of, places = [], []
                for i in range(part.last - part.first):
                    lo, hi = found.bounds[i], max(found.bounds[i], found.bounds[i + 1] - PASSAGE + 1)
                    own = wanted[part.first + i].values
                    places.append(np.arange(lo, hi) if own is None else lo + np.flatnonzero(np.isin(marks[lo:hi], own.to_numpy().view(np.uint64))))
                    texts_of.append(np.full(len(places[-1]), i))
                text, at = np.concatenate(texts_of).astype(np.int64), np.concatenate(places).astype(np.int64)
                points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80, dtype=np.int32)])
                breaks = np.concatenate([[0], np.cumsum(part.data == ord("\n"), dtype=np.int32)])
                begin, first = part.offsets[text], found.starts[at]
                last = found.ends[at + PASSAGE - 1] if len(at) else at
                ints = [at - found.bounds[text], breaks[first] - breaks[begin], points[first] - points[begin], points[last] - points[begin]]
                of = [batch.column(i).take(pa.array(part.first + text)) for i in range(len(kept))]
                own = [pa.array(hashes[at].view(np.int64)), *[pa.array(x.astype(np.int32)) for x in ints]]
                yield pa.RecordBatch.from_arrays([*of, *own], names=[*kept, *_PLACE])

    numbers = [F.lit(0).cast("bigint" if name == "hash" else "int").alias(name) for name in _PLACE]
    return shipped(texts).mapInArrow(run, texts.select(*kept, *numbers).schema)


def _ranked(ids: DataFrame, made: list[str]) -> DataFrame:
    """The rows with their ``rank``, 0, 1, ... by the first column; only counts of partitions pass the driver."""
    held = staged(ids.orderBy(ids.columns[0]).withColumn("at", F.monotonically_increasing_id()), "ordered", made)
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = held.sparkSession.createDataFrame([(p, first) for (p, _), first in zip(sizes, before[:-1], strict=True)], "part bigint, before bigint")
    return held.join(F.broadcast(offsets), part == F.col("part")).select(*ids.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans whose windows stand in several documents; columns as of ``repeated_paragraphs``."""
    spark, made = df.sparkSession, []
    docs = df.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("class"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.where(F.length("text") >= 2 * PASSAGE - 1)
    members = staged(docs.select("class", "doc_id"), "text-members")
    of = F.struct("doc_id")
    classes = staged(members.groupBy("class").agg(F.min(of).alias("least"), F.max(of).alias("most")), "text-classes", made)
    ids = staged(_ranked(classes.select(F.col("least.doc_id").alias("first_doc_id")).distinct(), made), "first-ids")
    # ``rank`` stands for the class's first document, ``several`` says that it has more than one.
    classes = classes.join(ids, F.col("least.doc_id").eqNullSafe(F.col("first_doc_id"))).select(
        "class", F.monotonically_increasing_id().alias("node"), "rank", (~F.col("least").eqNullSafe(F.col("most"))).alias("several"), "first_doc_id"
    )
    classes = staged(classes, "numbered-classes")
    short = F.xxhash64("class")
    marks = staged(text_marks(docs.select(short.alias("class"), "text")), "marks", made)
    shared = marks.groupBy("mark").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least != most").select("mark")
    wanted = marks.join(staged(shared, "shared-marks", made), "mark").groupBy("class").agg(F.collect_set("mark").alias("wanted"))
    # All windows of a text that several documents have are repeated.
    own = classes.join(wanted.withColumnRenamed("class", "short"), short == F.col("short"), "left").where("several OR wanted IS NOT NULL")
    own = own.select(F.col("class").alias("of"), "first_doc_id", "node", "rank", "several", F.when(~F.col("several"), F.col("wanted")).alias("wanted"))
    before, made = made, []
    own = staged(own, "wanted-marks", made)
    remove_scratch(spark, before)
    # By id and class: copies of one text meet nowhere.
    worked = docs.join(own, (F.col("class") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    windows = staged(marked_windows(worked.select("node", "rank", "several", "wanted", "text")), "windows", made)
    # ``at`` is the first document with a window and the first line that it has there; both are numbers, so that no rows are sorted.
    at = F.shiftleft("rank", LINE_BITS) + F.col("line")
    firsts = windows.groupBy("hash").agg(F.min(at).alias("at"), F.max("rank").alias("last"), F.max("several").alias("several"))
    firsts = firsts.where(F.col("several") | (F.shiftright("at", LINE_BITS) != F.col("last"))).select("hash", "at")
    found = windows.select("node", *_PLACE).join(staged(firsts, "first-windows", made), "hash")
    # A class that was worked twice has each window twice; these go on as well.
    in_text = Window.partitionBy("node").orderBy("word")
    first = F.shiftright("at", LINE_BITS)
    goes_on = (F.lag("word").over(in_text) >= F.col("word") - 1) & (F.lag(first).over(in_text) == first)
    found = found.withColumn("new", F.when(goes_on, 0).otherwise(1))
    spans = found.withColumn("span", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, 0))).groupBy("node", "span").agg(
        F.min(F.struct("word", "line", "start", "at")).alias("first"), F.max("end").alias("end")
    )
    spans = staged(spans.select("node", "first.line", "first.start", "end", "first.at"), "spans")
    remove_scratch(spark, made)
    spans = spans.withColumn("rank", first).join(ids, "rank").join(classes.select("node", "class"), "node")
    return members.join(spans, "class").select(
        "doc_id",
        *[F.col(name).cast("bigint").alias(name) for name in ("line", "start", "end")],
        "first_doc_id",
        F.col("at").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).alias("first_line"),
        (~F.col("doc_id").eqNullSafe(F.col("first_doc_id"))).alias("removed"),
    )


def repeated_paragraphs(
    df: DataFrame, near: Near = PARAGRAPH_NEAR, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """Paragraphs and passages that stand in several documents: ``doc_id``, ``line``, ``start``, ``end``, ``first_doc_id``, ``first_line``, ``removed``."""
    made: list[str] = []
    found = near_duplicates(paragraphs(df, key, text, least_words), near, "id", made=made)
    groups = found.groupBy("component_id").agg(
        F.min("doc_id.doc_id").alias("least"), F.max("doc_id.doc_id").alias("most"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("doc_id.doc_id").isNull().cast("int")).alias("null_id"),
    )
    several = groups.where("n > 1 AND (least != most OR (null_id = 1 AND least IS NOT NULL))").select(F.col("component_id").alias("of"))
    similar = staged(
        found.join(several, F.col("component_id") == F.col("of"), "left_semi").select(
            "doc_id.doc_id",
            "doc_id.line",
            "doc_id.start",
            "doc_id.end",
            F.col("component_id.doc_id").alias("first_doc_id"),
            F.col("component_id.line").alias("first_line"),
            (~F.col("kept")).alias("removed"),
        ),
        "similar-paragraphs",
    )
    remove_scratch(df.sparkSession, made)
    one, all_ = repeated_passages(df, key, text).alias("s"), similar.alias("p")
    covered = F.expr("s.doc_id <=> p.doc_id AND p.start <= s.start AND s.end <= p.end AND (p.removed OR NOT s.removed)")
    return similar.unionByName(one.join(all_, covered, "left_anti"))
