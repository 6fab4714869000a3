"""Token counts of a byte-level BPE vocabulary by prefix dynamic programming.

For every prefix of a piece of text, the last token of its encoding is the only vocabulary entry that
ends the prefix and can follow the last token of what stands before it. One pass over the piece
therefore gives the token count of every prefix: ``count[i] = count[i - len(last)] + 1``. Two tokens
can stand side by side if encoding their joined bytes gives them back, which is decided by undoing
merges from the newest on. Totals, the longest prefix within a budget and the count at any cut are
read from these counts; nothing is encoded again.

Pieces come from the splitting rule of byte-level BPE; a file with another rule, a normalizer or another
model is refused. A special token's string is one token.
Null is the empty text and has 0 tokens. Every input row gives one output row; repeated rows repeat; an
empty table gives no rows; an added column whose name is taken gets underscores.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_name, shipped
from .texts import Slice, run_hashes, slices

#: Words whose counts a worker keeps; it starts afresh when there are more.
KEPT_WORDS = 300_000
#: Pairs of tokens whose neighbourhood a worker keeps, likewise.
KEPT_PAIRS = 1_000_000
#: Longer words are counted without being kept.
KEPT_CHARACTERS = 48
#: Characters from which the counts inside a piece are kept while a cut in it is sought.
LONG_PIECE = 64

#: Fixed value: the splitting rule of byte-level BPE with ``use_regex``.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what a file with this rule says of its splitting, as far as it decides counts.
SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a ``tokenizers`` JSON file of kind byte-level BPE."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self._refuse_others(spec)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.endings = ahocorasick.Automaton()
        for token, i in ids.items():
            self.endings.add_word(raw(token).decode("latin-1"), (len(raw(token)), i))
        self.endings.make_automaton()
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.merged[pair] = (rank, whole)
            self.parts.setdefault(whole, (rank, *pair))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.specials = special
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self._beside: dict[int, bool] = {}

    @staticmethod
    def _refuse_others(spec: dict) -> None:
        rule, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if {name: rule.get(name) for name in SPLITTING} != SPLITTING or spec.get("normalizer"):
            raise ValueError(f"vocabulary file splits or changes texts in a way that is not supported: {rule}, {spec.get('normalizer')}")
        marks = [model.get(name) for name in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")]
        if model.get("type") != "BPE" or any(marks):
            raise ValueError("vocabulary file is not one of plain byte-level BPE")

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the newest merge on either side of the seam; a merge across the seam that came before it is a no.

        Equal ranks are the same merge at two places; the left place goes first.
        """
        limit, left_first = float("inf"), False
        while True:
            across = self.merged.get((left, right))
            if across and (across[0] < limit or (across[0] == limit and left_first)):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left, left_first = a[0], a[2], False
            else:
                limit, right, left_first = b[0], b[1], True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of each prefix of a piece; entry 0 is the empty prefix."""
        last, counts = [-1] + [None] * len(piece), [0] * (len(piece) + 1)
        pairs = self._beside
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        for at, (length, token) in self.endings.iter(piece.decode("latin-1")):
            end, begin = at + 1, at + 1 - length
            if last[end] is not None:
                continue
            if begin:
                pair = last[begin] << 32 | token
                apart = pairs.get(pair)
                if apart is None:
                    apart = pairs[pair] = self._stay_apart(last[begin], token)
                if not apart:
                    continue
            last[end], counts[end] = token, counts[begin] + 1
        return counts

    def holds_special(self, text: str) -> bool:
        return any(token in text for token in self.specials)

    def split(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text and whether each is a special token."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            for piece in self.pieces.finditer(text[at : found.start()]):
                yield piece.group(), False
            yield found.group(), True
            at = found.end()
        for piece in self.pieces.finditer(text[at:]):
            yield piece.group(), False


class Counts:
    """Token counts of texts; counts of the stretches and pieces met lately are kept.

    A piece never goes on over a space that a non-blank character follows, so a text is cut there and
    the stretches are counted on their own. Stretches are known by 64-bit hashes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.by_hash: dict[int, int] = {}
        self.by_piece: dict[str, int] = {}
        # No cut before what may be a blank (also of several bytes) or a special token.
        self.cut_before = np.ones(256, dtype=bool)
        self.cut_before[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
        self.cut_before[[ord(token[:1].encode()[:1]) for token in vocabulary.specials]] = False

    def piece(self, piece: str) -> int:
        count = self.by_piece.get(piece)
        if count is None:
            count = self.vocabulary.prefix_counts(piece.encode())[-1]
            if len(piece) <= KEPT_CHARACTERS:
                self.by_piece[piece] = count
        return count

    def total(self, text: str) -> int:
        if self.vocabulary.holds_special(text):
            return sum(1 if is_special else self.piece(piece) for piece, is_special in self.vocabulary.split(text))
        return sum(map(self.piece, self.vocabulary.pieces.findall(text)))

    def totals(self, part: Slice) -> np.ndarray:
        """Of each text of a slice."""
        data, offsets = part.data, part.offsets
        if len(self.by_hash) > KEPT_WORDS:
            self.by_hash.clear()
        if len(self.by_piece) > KEPT_WORDS:
            self.by_piece.clear()
        cut = np.zeros(len(data) + 1, dtype=bool)
        if not any(" " in token for token in self.vocabulary.specials):
            cut[: len(data) - 1] = (data[:-1] == 32) & self.cut_before[data[1:]]
            cut[offsets[1:] - 1] = False  # the blank a text ends with
        cut[offsets[:-1]] = True
        cut[len(data)] = False
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.zeros(len(offsets) - 1, dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        hashes, first, place = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        counts = np.zeros(len(hashes), dtype=np.int64)
        for i, key in enumerate(hashes.tolist()):
            count = self.by_hash.get(key)
            if count is None:
                k = first[i]
                count = self.by_hash[key] = self.total(data[starts[k] : ends[k]].tobytes().decode())
            counts[i] = count
        sums = np.concatenate([[0], np.cumsum(counts[place])])
        bounds = np.searchsorted(starts, offsets)
        return sums[bounds[1:]] - sums[bounds[:-1]]


class Prefixes:
    """Exact token counts of every prefix of one text that ends between characters.

    Cutting a text may change how its end is split: white space before the cut joins the piece before
    it. So the count at a cut is the count where the last whole piece begins plus the counts of what
    stands between there and the cut, split anew. With ``budget`` only as much of the text is split as
    ``longest(budget)`` needs.
    """

    def __init__(self, counts: Counts, text: str, budget: int | None = None):
        self.counts, self.text = counts, text
        self.ends, self.totals, self._long = [0], [0], {}
        for piece, is_special in counts.vocabulary.split(text):
            self.ends.append(self.ends[-1] + len(piece))
            self.totals.append(self.totals[-1] + (1 if is_special else counts.piece(piece)))
            if budget is not None and len(self.totals) > 2 and self.totals[-3] > budget:
                break

    def at(self, cut: int) -> int:
        """Tokens of ``text[:cut]``."""
        k = bisect_left(self.ends, cut) - 1
        if k >= 0 and self.ends[k + 1] - self.ends[k] > LONG_PIECE:
            return self.totals[k] + self._inside(k)[cut - self.ends[k]]
        k = max(0, k - 1)
        return self.totals[k] + self.counts.total(self.text[self.ends[k] : cut])

    def _inside(self, k: int) -> list[int]:
        """Counts by characters of one long piece; any beginning of it is a single piece too."""
        if k not in self._long:
            piece = self.text[self.ends[k] : self.ends[k + 1]]
            counts = self.counts.vocabulary.prefix_counts(piece.encode())
            places = accumulate((len(c.encode()) for c in piece), initial=0)
            self._long = {k: [counts[i] for i in places]}
        return self._long[k]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens.

        Behind the second piece that exceeds the budget no cut can fit.
        """
        k = bisect_right(self.totals, budget) - 1
        reach = min(len(self.ends) - 1, k + 2)
        return next((cut for cut in range(self.ends[reach], 0, -1) if self.at(cut) <= budget), 0)


_loaded: dict[int, Counts] = {}


def _counter(text: str) -> Counts:
    """One per worker and vocabulary; Python workers are reused between tasks."""
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counts(Vocabulary(text))
    return _loaded[key]


def token_counts(
    df: DataFrame, vocabulary_file: str, text: str = "text", budget: int | None = None, count_name: str = "n_tokens"
) -> DataFrame:
    """The frame with its token counts, and with ``budget`` also the characters that fit it (``fit_chars``).

    ``vocabulary_file`` is read on the driver and sent to the workers; its size doesn't depend on the data.
    """
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    Vocabulary._refuse_others(json.loads(content))
    shared = df.sparkSession.sparkContext.broadcast(content)
    count_name = free_name(df, count_name)
    fit_name = free_name(df, "fit_chars")
    added = [F.lit(0).cast("long").alias(count_name)] + ([F.lit(0).cast("long").alias(fit_name)] if budget is not None else [])
    schema = df.select("*", *added).schema
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(shared.value)
        for batch in batches:
            totals, fits = [], []
            for part in slices(batch.column(place)):
                found = counts.totals(part).tolist()
                totals += found
                if budget is not None:
                    texts = batch.column(place)[part.first : part.last].to_pylist()
                    fits += [
                        len(t or "") if n <= budget else Prefixes(counts, t, budget).longest(budget)
                        for t, n in zip(texts, found, strict=True)
                    ]
            out = [*batch.columns, pa.array(totals, pa.int64())] + ([pa.array(fits, pa.int64())] if budget is not None else [])
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return shipped(df).mapInArrow(run, schema)
