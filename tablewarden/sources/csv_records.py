"""CSV records of any file in parallel, line breaks in quotes included.

Spark deals a file to tasks in byte ranges, and the text source starts each range at a line. Whether that
line also starts a record depends on every quote before it. A line is therefore seen as a map from the
state before it (outside or inside of quotes) to the state after it; ranges are maps too, composed of
their lines by one pass, in parallel. Following the ranges of a file from its beginning then gives the
state at the start of each: one small row per range, a few bits of it kept. With these, a second pass
joins the lines of each range to records. What is left are the pieces of records that cross a border
between ranges, at most two a range; only these are shuffled, to be put together.

A quote opens a field only at the field's start, as CSV has it; elsewhere it is a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AuditError
from .workers import ship

_BOM = "﻿"
_SCAN = "kind int, file bigint, block bigint, path string, after_out boolean, after_in boolean, closes boolean, opens boolean, record binary"
_GLUED = "record binary, first boolean, file bigint, opened bigint, block bigint"
#: Rows of the first pass: a byte range, the first record of a file, another record of the sample.
RANGE, HEADER, SAMPLE = 0, 1, 2


def _after(inside: str) -> str:
    """Whether a line that starts in the given state ends inside quotes.

    ``edge`` tells that a quote without text before it is at a field's start, or doubled.
    """
    other = "false" if inside == "true" else "true"
    return (
        f"CASE WHEN contains(value, '\"') THEN aggregate(slice(split(value, '\"'), 1, size(split(value, '\"')) - 1), "
        f"named_struct('inside', {inside}, 'edge', {other}), (s, p) -> CASE "
        "WHEN s.inside THEN named_struct('inside', false, 'edge', true) "
        f"WHEN endswith(p, ',') OR s.edge AND p IN ('', '{_BOM}') THEN named_struct('inside', true, 'edge', false) "
        f"ELSE named_struct('inside', false, 'edge', false) END, s -> s.inside) ELSE {inside} END"
    )


def _lines(spark: SparkSession, paths: list[str], text: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_path").alias("path") if text else F.lit(None).cast("string").alias("path"),
        F.expr(_after("false")).alias("after_out"),
        F.expr(_after("true")).alias("after_in"),
        F.expr(f"CAST({text or 'value'} AS BINARY)").alias("line"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Lines of a batch by byte range."""
    file, block = (batch.column(i).to_numpy() for i in (0, 1))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
        if hi > lo:
            yield int(file[lo]), int(block[lo]), batch.slice(lo, hi - lo)


def _states(run: pa.RecordBatch, inside: bool) -> np.ndarray:
    """Whether each line ends inside quotes, from the state before the first.

    A line either fixes the state, or turns it, or leaves it: what counts is the last one that fixes it
    and the number of turns since.
    """
    out, held = (pc.fill_null(run.column(i), False).to_numpy(zero_copy_only=False) for i in (3, 4))
    fixes, turns = out == held, np.cumsum(out & ~held)
    last = np.maximum.accumulate(np.where(fixes, np.arange(len(out)), -1))
    base = np.where(last >= 0, out[last], inside)
    since = turns - np.where(last >= 0, turns[last], 0)
    return base ^ (since & 1).astype(bool)


def _joined(lines: pa.Array, ends: np.ndarray, before: list[bytes]) -> pa.Array:
    """Records: lines up to each end (inclusive), with line breaks between them, the first after ``before``."""
    if before:
        lines = pa.concat_arrays([pa.array(before, pa.large_binary()), lines])
    offsets = pa.array(np.concatenate([[0], ends + 1 + len(before)]), pa.int64())
    records = pc.binary_join(pa.LargeListArray.from_arrays(offsets, lines), pa.scalar(b"\n", pa.large_binary()))
    # Lines of other systems end with a carriage return; within quotes it belongs to the text.
    ending = pc.ends_with(records, b"\r")
    return pc.if_else(ending, pc.binary_slice(records, 0, -1), records) if pc.any(ending).as_py() else records


def _scan(sample_rows: int):
    """One row per byte range with its map; the first records of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        path, ends, closes, opens = "", (False, True), False, False
        open_lines: list[bytes] = []
        records = 0

        def rows(kind: int, held: list, place: tuple[int, int], state: tuple[bool, ...]) -> pa.RecordBatch:
            n = len(held)
            columns = [[kind] * n, [place[0]] * n, [place[1]] * n, [path] * n, *[[s] * n for s in state], held]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4, pa.binary())
            names = ["kind", "file", "block", "path", "after_out", "after_in", "closes", "opens", "record"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for file, block, lines in _runs(batch):
                if key != (file, block):
                    if key is not None:
                        yield rows(RANGE, [None], key, (*ends, closes, opens))
                    key, path, ends = (file, block), lines.column(2)[0].as_py(), (False, True)
                    closes = opens = False
                    open_lines, records = [], 0
                before = ends[0]
                from_out, from_in = _states(lines, ends[0]), _states(lines, ends[1])
                closes = closes or not pc.all(lines.column(4)).as_py()
                opens = opens or pc.any(lines.column(3)).as_py()
                ends = bool(from_out[-1]), bool(from_in[-1])
                if block == 0 and records <= sample_rows:
                    at = np.flatnonzero(~from_out)[: sample_rows + 1 - records]
                    body = lines.column(5).cast(pa.large_binary())
                    if len(at):
                        found = _joined(body, at, open_lines if before else []).to_pylist()
                        open_lines = body.slice(int(at[-1]) + 1).to_pylist() if records + len(at) <= sample_rows else []
                        for kind, held in ((HEADER, found[: records == 0]), (SAMPLE, found[records == 0 :])):
                            if held:
                                yield rows(kind, held, key, (False,) * 4)
                        records += len(found)
                    else:
                        open_lines += body.to_pylist()
        if key is not None:
            yield rows(RANGE, [None], key, (*ends, closes, opens))

    return run


@dataclass(frozen=True)
class Borders:
    """For each file, the byte ranges that start inside quotes, and where the record they are in begins."""

    ranges: int
    inside: dict[int, tuple[np.ndarray, np.ndarray]]
    #: Whether any line that starts outside of quotes would end inside.
    breaks: bool


def scanned(spark: SparkSession, paths: list[str], sample_rows: int) -> DataFrame:
    """The first pass over the files; persist it while it is used."""
    ship(spark)
    # Lines travel only where a sample is taken, at the beginning of a file.
    text = "CASE WHEN _metadata.file_block_start = 0 THEN value END"
    return _lines(spark, paths, text).mapInArrow(_scan(sample_rows), _SCAN)


def borders(scan: DataFrame) -> Borders:
    """States at the borders, from one row per byte range."""
    ranges = scan.where(F.col("kind") == RANGE).select("file", "block", "path", "after_out", "after_in", "closes", "opens").toPandas()
    inside: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for file, own in ranges.sort_values(["file", "block"]).groupby("file"):
        state, opened = False, 0
        blocks, begins = [], []
        for block, after_out, after_in, closes in zip(own["block"], own["after_out"], own["after_in"], own["closes"], strict=True):
            if state:
                blocks.append(block)
                begins.append(opened)
            # A record begins here unless the range lies within one.
            opened = block if not state or closes else opened
            state = after_in if state else after_out
        if state:
            raise AuditError(f"a quote in {own['path'].iloc[0]} is never closed")
        if blocks:
            inside[int(file)] = (np.array(blocks, dtype=np.int64), np.array(begins, dtype=np.int64))
    return Borders(len(ranges), inside, bool(ranges["opens"].any()))


def headers(scan: DataFrame) -> DataFrame:
    """``record``: the first record of every file that has one."""
    found = scan.where(F.col("kind") == HEADER).select(F.col("record").cast("string").alias("record"))
    return found.select(F.ltrim("record", F.lit(_BOM)).alias("record"))


def sample(scan: DataFrame) -> DataFrame:
    found = scan.where(F.col("kind") == SAMPLE).select(F.col("record").cast("string").alias("record"))
    return found.where("trim(record) <> ''")


def _glue(known: Borders):
    """Whole records, and the pieces of those that cross a border, with the range where the record begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        state, opened, first = False, 0, False
        open_lines: list[bytes] = []

        def piece(place: tuple[int, int]) -> pa.RecordBatch:
            columns = [pa.array([b"\n".join(open_lines)], pa.binary()), pa.array([first])]
            columns += [pa.array([v], pa.int64()) for v in (place[0], opened, place[1])]
            return pa.RecordBatch.from_arrays(columns, names=["record", "first", "file", "opened", "block"])

        for batch in batches:
            for file, block, lines in _runs(batch):
                if key != (file, block):
                    if key is not None and open_lines:
                        yield piece(key)
                    key, open_lines, opened, state = (file, block), [], block, False
                    if file in known.inside:
                        blocks, begins = known.inside[file]
                        at = int(np.searchsorted(blocks, block))
                        if at < len(blocks) and blocks[at] == block:
                            state, opened = True, int(begins[at])
                    first = block == 0
                states = _states(lines, state)
                body = lines.column(5).cast(pa.large_binary())
                at = np.flatnonzero(~states)
                if len(at):
                    records = _joined(body, at, open_lines)
                    if opened != block:
                        # The end of a record that began in another range.
                        open_lines = [records[0].as_py()]
                        yield piece(key)
                        records, opened = records.slice(1), block
                    n = len(records)
                    flags = np.zeros(n, dtype=bool)
                    if n:
                        flags[0], first = first, False
                        nothing = pa.nulls(n, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [records.cast(pa.binary()), pa.array(flags), nothing, nothing, nothing],
                            names=["record", "first", "file", "opened", "block"],
                        )
                    open_lines = body.slice(int(at[-1]) + 1).to_pylist()
                else:
                    open_lines += body.to_pylist()
                state = bool(states[-1])
        if key is not None and open_lines:
            yield piece(key)

    return run


def records(spark: SparkSession, paths: list[str], known: Borders) -> DataFrame:
    """``record``: every record but the headers and blank lines; records across borders come last."""
    ship(spark)
    glued = _lines(spark, paths, "").mapInArrow(_glue(known), _GLUED)
    whole = glued.where("file IS NULL").select("record", "first")
    if known.inside:
        # Read once: the pieces are few, and without them every use of the table would read the files twice.
        pieces = glued.where("file IS NOT NULL").persist()
        crossing = pieces.groupBy("file", "opened").agg(
            F.expr("array_join(transform(array_sort(collect_list(struct(block, record))), p -> CAST(p.record AS STRING)), '\n')").alias("record"),
            F.max("first").alias("first"),
        )
        whole = whole.union(crossing.select(F.col("record").cast("binary"), "first"))
    return whole.where("NOT first").select(F.col("record").cast("string").alias("record")).where("trim(record) <> ''")
