"""Benchmark decontamination with one FM-index per shard of the training texts.

A shard is a slice of a partition. Its words become symbols and an FM-index is built over them; all
windows of the benchmark are searched backwards at once, and the occurrences found are merged to
removal spans. Words that no window holds cannot be part of an occurrence: the index keeps only runs
of benchmark words long enough for the shortest window, with a separator behind each.

The benchmark goes to the workers in blocks of at most ``BLOCK_WORDS`` words (or one item), one pass
over the texts per block, so what is sent has a fixed size. Usually one block holds all of it.

Defined cases: A-Z are a-z; null texts have no words and no hits; items without words match nothing;
an item with fewer than 13 words is one window; rows with the same item id are one item, and a null
item id counts as the empty string; each text is judged alone, so repeated rows repeat; an empty
table gives no rows and an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .tables import shipped
from .texts import Slice, Words, slices, words

WINDOW = 13
BLOCK_WORDS = 500_000
SHARD_BYTES = 4 << 20
SEPARATOR = 1


@dataclass
class Phrases:
    """Distinct windows as lines of symbols, right-aligned; their items; the hashes behind symbols 2, 3, ..."""

    hashes: np.ndarray
    lines: np.ndarray
    lengths: np.ndarray
    phrase: np.ndarray
    item: np.ndarray
    items: list[str]


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    part = list(slices(pa.array([t for _, t in items], pa.string()), 1 << 62))
    found = words(part[0], "alphanumeric") if part else None
    lines, owners = [], []
    for i in range(len(items)):
        own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            lines.append(own[at : at + size])
            owners.append(i)
    known = np.unique(np.concatenate(lines)) if lines else np.zeros(0, np.uint64)
    table = np.zeros((len(lines), window), dtype=np.int64)
    for i, line in enumerate(lines):
        table[i, window - len(line) :] = np.searchsorted(known, line) + 2
    distinct, place = np.unique(table, axis=0, return_inverse=True)
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    pairs = np.unique(np.array([[p, number[items[i][0]]] for p, i in zip(place.ravel(), owners, strict=True)], dtype=np.int64).reshape(-1, 2), axis=0)
    return Phrases(known, distinct, (distinct > 0).sum(axis=1), pairs[:, 0], pairs[:, 1], names)


def _indexed(found: Words, sought: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the runs that may hold a window, and the word behind each symbol (-1: a separator)."""
    nearest = np.minimum(np.searchsorted(sought.hashes, found.hashes), len(sought.hashes) - 1)
    known = sought.hashes[nearest] == found.hashes
    places = np.flatnonzero(known)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A run ends where the next word is not a neighbour in the same text.
    text = np.searchsorted(found.bounds, places, side="right")
    fresh = np.ones(len(places), dtype=bool)
    fresh[1:] = (np.diff(places) != 1) | (np.diff(text) != 0)
    run = np.cumsum(fresh) - 1
    long = np.bincount(run)[run] >= sought.lengths.min()
    places, run = places[long], run[long]
    behind = np.arange(len(places)) + np.searchsorted(np.unique(run), run)
    symbols = np.full(len(places) + (len(np.unique(run)) if len(run) else 0), SEPARATOR, dtype=np.int64)
    origin = np.full(len(symbols), -1, dtype=np.int64)
    symbols[behind], origin[behind] = nearest[places] + 2, places
    return symbols, origin


def occurrences(found: Words, sought: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase of every occurrence of every phrase."""
    nothing = np.zeros(0, np.int64)
    if not len(sought.lines) or not len(found.hashes):
        return nothing, nothing
    symbols, origin = _indexed(found, sought)
    if not len(symbols):
        return nothing, nothing
    index = FMIndex(symbols)
    low, high = index.search(sought.lines, sought.lengths)
    counts = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(low)), counts)
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return origin[index.locate(rows)], phrase


def _spans(part: Slice, found: Words, hit: np.ndarray, text: int) -> list[dict]:
    """Merged runs of hit words of one text, in code points."""
    lo, hi = found.bounds[text], found.bounds[text + 1]
    own = np.flatnonzero(hit[lo:hi])
    if not len(own):
        return []
    first = own[np.insert(np.diff(own) > 1, 0, True)] + lo
    last = own[np.append(np.diff(own) > 1, True)] + lo
    raw = part.data[part.offsets[text] : part.offsets[text + 1]]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = part.offsets[text]
    return [{"start": int(a), "end": int(b)} for a, b in zip(before[found.starts[first] - at], before[found.ends[last] - at], strict=True)]


SPANS = "array<struct<start:bigint,end:bigint>>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        block.append((item, text))
        size += len((text or "").split())
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _pass(df: DataFrame, place: int, block: list[tuple[str, str | None]], last: bool) -> DataFrame:
    """Adds the hits of one block to ``hits_`` (spans) and ``items_``; the last pass measures the texts instead."""
    shared = df.sparkSession.sparkContext.broadcast(phrases(block))
    added = {"n_words": "bigint", "n_hit": "bigint", "item_ids": "array<string>", "spans": SPANS}
    kept = df.drop("hits_", "items_") if last else df
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in added.items()] if last else []
    schema = kept.select("*", *nulls).schema
    given = df.columns
    hits, items = given.index("hits_"), given.index("items_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought: Phrases = shared.value
        for batch in batches:
            spans, names = batch.column(hits).to_pylist(), batch.column(items).to_pylist()
            words_in, words_hit = [], []
            for part in slices(batch.column(place), SHARD_BYTES):
                found = words(part, "alphanumeric")
                start, phrase = occurrences(found, sought)
                edge = np.zeros(len(found.hashes) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + sought.lengths[phrase], -1)
                hit = np.cumsum(edge[:-1]) > 0
                counted = np.concatenate([[0], np.cumsum(hit)])[found.bounds]
                text = np.searchsorted(found.bounds, start, side="right") - 1
                pairs = np.unique(np.stack([text, phrase], axis=1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
                totals = np.diff(counted).tolist()
                for i in np.flatnonzero([bool(s) for s in spans[part.first : part.last]]).tolist():
                    # Words hit by earlier blocks count too.
                    own = _merged([*spans[part.first + i], *_spans(part, found, hit, i)])
                    totals[i] = _words_inside(part, found, i, own)
                for i in np.unique(text).tolist():
                    own = pairs[pairs[:, 0] == i, 1]
                    held = {sought.items[k] for p in own for k in sought.item[np.searchsorted(sought.phrase, p) : np.searchsorted(sought.phrase, p, "right")]}
                    row = part.first + i
                    names[row] = sorted({*names[row], *held})
                    spans[row] = _merged([*spans[row], *_spans(part, found, hit, i)])
                words_in += np.diff(found.bounds).tolist()
                words_hit += totals
            columns = {name: batch.column(i) for i, name in enumerate(given)}
            columns |= {"hits_": pa.array(spans, batch.column(hits).type), "items_": pa.array(names, batch.column(items).type)}
            if last:
                columns |= {"spans": columns["hits_"], "item_ids": columns["items_"]}
                columns |= {"n_words": pa.array(words_in, pa.int64()), "n_hit": pa.array(words_hit, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[name] for name in schema.names], names=schema.names)

    return shipped(df).mapInArrow(run, schema)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _words_inside(part: Slice, found: Words, text: int, spans: list[dict]) -> int:
    raw = part.data[part.offsets[text] : part.offsets[text + 1]]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts = before[found.starts[found.bounds[text] : found.bounds[text + 1]] - part.offsets[text]]
    return sum(int(np.searchsorted(starts, s["end"]) - np.searchsorted(starts, s["start"])) for s in spans)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows with ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings), ``spans`` and ``contaminated``.

    Columns that clash with these are dropped. ``spans`` are merged, in code points, end exclusive.
    """
    added = ("n_words", "n_hit", "item_ids", "spans", "contaminated", "hits_", "items_")
    kept = docs.select([F.col(c) for c in docs.columns if c.lower() not in added])
    place = kept.columns.index(text)
    out = kept.withColumn("hits_", F.array().cast(SPANS)).withColumn("items_", F.array().cast("array<string>"))
    listed = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    block: list[tuple[str, str | None]] = []
    for following in _blocks(listed):
        if block:
            out = _pass(out, place, block, last=False)
        block = following
    return _pass(out, place, block, last=True).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
