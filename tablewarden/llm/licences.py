"""License scans with a positional index of rare words.

A template is one sentence of a licence notice, or the name of a licence. Some of its words are key
phrases, which must stand in the text word for word; the others may differ up to a share. The index
holds, for the two key words of each template that are rarest in the corpus, where they stand in it.
Every text's licence words with the highest inverse document frequency are looked up there: each gives
a place where the template would begin, and only places that both words agree on are verified, first
the key phrases, then the share of equal words. As both words are part of the key phrases, no match is
lost, whatever the frequencies are; rare words only keep the number of places to verify small.

Document frequencies of the licence words are counted over all texts by the first of two passes; a few
hundred numbers pass the driver. The second pass judges each text alone, so there is no shuffle of texts.
64-bit hashes stand for words.

Defined cases: null is the empty text and has no words; each row is judged alone, so repeated rows
repeat and ids may be null; a word repeats in a template or text as often as it likes; an empty table
gives no rows. Only the key columns and the text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shipped
from .texts import Slice, Words, slices, words

# Names of licences whose places are counted, with their labels.
NAMES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Sentences of licence notices; key phrases stand in brackets.
NOTICES = (
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("apache-2.0", "you may not use this file except in [compliance with the license]"),
    ("apache-2.0", "you may obtain a copy of the license at http [www apache org licenses] license 2 0"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis [without warranties or conditions of any kind]"),
    ("gpl-3.0", "this work is licensed under the [gnu general public license version 3]"),
    ("gpl-3.0", "either [version 3 of the license] or at your option any later version"),
    ("gpl-2.0", "either [version 2 of the license] or at your option any later version"),
    ("gpl", "it under the terms of the [gnu general public license] as published by the [free software foundation]"),
    ("lgpl", "it under the terms of the [gnu lesser general public license] as published by the [free software foundation]"),
    ("agpl", "it under the terms of the [gnu affero general public license] as published by the [free software foundation]"),
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice [shall be included in all copies] or substantial portions of the software"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that] the following conditions are met"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be [used to endorse or promote products]"),
    ("isc", "[permission to use copy modify] and or distribute this software for any purpose with or without fee [is hereby granted]"),
    ("mpl-2.0", "this source code form is [subject to the terms of the mozilla public license] v 2 0"),
    ("epl-2.0", "the accompanying materials are made available under the terms of the [eclipse public license] 2 0"),
    ("unlicense", "this is [free and unencumbered software] released into the public domain"),
    ("cc0-1.0", "to the extent possible under law [has waived all copyright] and related or neighboring rights to this work"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-4.0", "this work is licensed under a [creative commons attribution 4 0] international license"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-sa-4.0", "this work is licensed under a [creative commons attribution sharealike 4 0] international license"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-nc-4.0", "this work is licensed under a [creative commons attribution noncommercial 4 0] international license"),
    ("cc-by-nd-4.0", "licensed under [cc by nd 4 0]"),
)

#: Share of a template's words that must stand in their places.
SHARE = 0.6
#: A match of n words scores its share times n / (n + this).
DOUBT = 2

PLACES = "array<struct<label:string,start:bigint,n_words:int,share:double>>"


@dataclass(frozen=True)
class Template:
    """``base`` templates are names that are counted; ``key`` marks the words of key phrases."""

    label: str
    words: tuple[str, ...]
    key: tuple[bool, ...]
    base: bool = False


def template(label: str, text: str, base: bool = False) -> Template:
    """A template from its words, key phrases in brackets; without brackets every word is key."""
    inside, found, key = "[" not in text, [], []
    for piece in text.replace("[", " [ ").replace("]", " ] ").split():
        if piece in "[]":
            inside = piece == "["
        else:
            found.append(piece)
            key.append(inside)
    return Template(label, tuple(found), tuple(key), base)


TEMPLATES = tuple(template(label, text, True) for label, text in NAMES) + tuple(template(label, text) for label, text in NOTICES)


def word_hashes(names: Sequence[str]) -> np.ndarray:
    """Hashes of words as texts have them."""
    data = np.frombuffer(" ".join(names).encode(), dtype=np.uint8)
    return words(Slice(0, 1, data, np.array([0, len(data)], dtype=np.int64)), "alphanumeric").hashes


def _held(found: Words, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are in ``sought`` (sorted), and which ones they are."""
    rank = np.minimum(np.searchsorted(sought, found.hashes), len(sought) - 1)
    at = np.flatnonzero(sought[rank] == found.hashes)
    return at, rank[at]


def document_frequencies(df: DataFrame, names: Sequence[str], text: str) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many of them each word stands."""
    hashes = word_hashes(names)
    order = np.argsort(hashes)
    sought = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts = 0, np.zeros(len(sought), dtype=np.int64)
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch.column(0)):
                found = words(part, "alphanumeric")
                at, rank = _held(found, sought)
                text_of = np.searchsorted(found.bounds, at, side="right") - 1
                counts += np.bincount(np.unique(text_of * len(sought) + rank) % len(sought), minlength=len(sought))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *order.tolist()], pa.int32()), pa.array([rows, *counts.tolist()], pa.int64())], names=["word", "n"]
        )

    counted = shipped(df).select(F.col(text)).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # One row per licence word.
    total = {row["word"]: row["n"] for row in counted.collect()}
    return total.get(-1, 0), {name: total.get(i, 0) for i, name in enumerate(names)}


@dataclass(frozen=True)
class Index:
    """Postings of each template's two rarest key words, and what has to be verified."""

    templates: tuple[Template, ...]
    hashes: tuple[np.ndarray, ...]
    #: Sorted hashes of the indexed words, and for each its postings (template, place in it).
    sought: np.ndarray
    postings: tuple[tuple[tuple[int, int], ...], ...]
    #: For each template the place of the other word.
    other: tuple[int, ...]


def positional_index(templates: Sequence[Template], frequency: dict[str, int]) -> Index:
    """Rarest first; of equally rare words the earlier one, and of a repeated word its first place."""
    postings: dict[str, list[tuple[int, int]]] = {}
    other = []
    for t, held in enumerate(templates):
        places = [i for i, is_key in enumerate(held.key) if is_key]
        rare = sorted(places, key=lambda i: (frequency.get(held.words[i], 0), i))
        postings.setdefault(held.words[rare[0]], []).append((t, rare[0]))
        other.append(rare[1] if len(rare) > 1 else rare[0])
    names = list(postings)
    hashes = word_hashes(names)
    order = np.argsort(hashes)
    return Index(
        tuple(templates),
        tuple(word_hashes(held.words) for held in templates),
        hashes[order],
        tuple(tuple(postings[names[i]]) for i in order),
        tuple(other),
    )


def matches(found: Words, index: Index, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Template, first words and shares of its matches in the texts of a slice."""
    at, rank = _held(found, index.sought)
    order = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[order], np.arange(len(index.sought) + 1))
    for word, postings in enumerate(index.postings):
        own = at[order[edges[word] : edges[word + 1]]]
        text = np.searchsorted(found.bounds, own, side="right") - 1
        for t, place in postings:
            wanted, key = index.hashes[t], np.array(index.templates[t].key)
            # Beginnings by the rarest word; both words, then all key words, must agree on them.
            start = own - place
            inside = (start + np.flatnonzero(key)[0] >= found.bounds[text]) & (start + np.flatnonzero(key)[-1] < found.bounds[text + 1])
            start, own_text = start[inside], text[inside]
            for k in [index.other[t], *np.flatnonzero(key).tolist()]:
                same = found.hashes[start + k] == wanted[k]
                start, own_text = start[same], own_text[same]
            if not len(start):
                continue
            places = start[:, None] + np.arange(len(wanted))
            inside = (places >= found.bounds[own_text][:, None]) & (places < found.bounds[own_text + 1][:, None])
            equal = inside & (found.hashes[np.clip(places, 0, len(found.hashes) - 1)] == wanted)
            held = equal.sum(axis=1) / len(wanted)
            good = held >= share
            yield t, start[good], held[good]


def _joined(labels: set[str]) -> str:
    return ",".join(sorted(labels))


def license_scans(
    df: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", templates: Sequence[Template] = TEMPLATES, share: float = SHARE
) -> DataFrame:
    """Per row its ``key`` columns and what was found in the text.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``, ``base_labels`` of the base templates' places;
    ``labels`` of all templates; ``score``, the best match's share of words, weighed down if it is short;
    ``places``, every match by its first word (before the text's first word where a template begins with
    words that the text does not have), then label and length. Key columns with such names are dropped.
    """
    vocabulary = sorted({w for held in templates for w in held.words})
    _, frequency = document_frequencies(df, vocabulary, text)
    index = positional_index(templates, frequency)
    added = {
        "n_words": "bigint",
        "n_base": "bigint",
        "first_word": "bigint",
        "last_word": "bigint",
        "base_labels": "string",
        "labels": "string",
        "score": "double",
        "places": PLACES,
    }
    keys = [k for k in key if k.lower() not in added]
    rows = shipped(df).select(*keys, F.col(text).alias("text_"))
    schema = rows.select(*keys, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            held: list[list[tuple[int, str, int, float, bool]]] = [[] for _ in range(batch.num_rows)]
            for part in slices(batch.column(len(keys))):
                found = words(part, "alphanumeric")
                counts += np.diff(found.bounds).tolist()
                for t, starts, shares in matches(found, index, share):
                    own = index.templates[t]
                    # A template may begin before the text; its first key word is always inside.
                    inside = starts + own.key.index(True)
                    for begin, of, equal in zip(starts.tolist(), (np.searchsorted(found.bounds, inside, side="right") - 1).tolist(), shares.tolist(), strict=True):
                        held[part.first + of].append((begin - int(found.bounds[of]), own.label, len(own.words), equal, own.base))
            columns: list[list] = [[] for _ in added]
            for n, own in zip(counts, held, strict=True):
                own.sort()
                base = [m for m in own if m[4]]
                row = (
                    n,
                    len(base),
                    base[0][0] if base else None,
                    base[-1][0] if base else None,
                    _joined({m[1] for m in base}),
                    _joined({m[1] for m in own}),
                    max((m[3] * m[2] / (m[2] + DOUBT) for m in own), default=0.0),
                    [{"label": m[1], "start": m[0], "n_words": m[2], "share": m[3]} for m in own],
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            given = [batch.column(i) for i in range(len(keys))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), PLACES_ARROW)
            yield pa.RecordBatch.from_arrays([*given, *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


PLACES_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64())]))
