"""Words and word hashes of whole Arrow batches, with numpy.

A batch is worked in slices of whole texts, so that memory follows the slice size and the longest
single text. Nothing here looks at more than one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_HASHED_BYTES = 1 << 15

#: Bytes that end a word: space and tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"

_random = np.random.Generator(np.random.PCG64(20240607))
_POWERS = 1 << 16
_BASE = np.uint64(int(_random.integers(1 << 40, 1 << 62)) | 5)


def _powers(base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(_POWERS, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers()
#: A power of the inverse modulo 2^64 takes a power of the base back to 1.
_BACK = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Slice:
    """Whole texts ``first`` to ``last`` of a batch: their bytes, and where each begins (and the last one ends)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its texts; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if not len(column):
        return
    data, offsets = utf8(column)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        lo, hi = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


@dataclass
class Words:
    """Words of a slice in text order: begin and end byte, hash, and for each text the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _letters(solid: np.ndarray) -> np.ndarray:
    """Hash values of bytes: the same for A-Z as for a-z, none for those between words."""
    values = _BYTE.copy()
    values[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
    values[~solid] = 0
    return values


def _kinds() -> dict[str, np.ndarray]:
    """Bytes of words: all but blanks, or only digits, letters and what is not ASCII."""
    solid = np.ones(256, dtype=bool)
    solid[list(BLANKS)] = False
    alphanumeric = np.zeros(256, dtype=bool)
    alphanumeric[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return {"solid": solid, "alphanumeric": alphanumeric}


_KINDS = _kinds()
_VALUES = {name: _letters(kind) for name, kind in _KINDS.items()}


def words(part: Slice, kind: str = "solid") -> Words:
    """Runs of bytes of a kind; the hash takes A-Z as a-z."""
    solid = _KINDS[kind][part.data]
    n = len(solid)
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = part.offsets[(part.offsets > 0) & (part.offsets < n)]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, part.offsets)
    return Words(starts, ends, run_hashes(part.data, starts, ends, _VALUES[kind]), bounds)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Polynomial of random byte values per run, in blocks that stay in a processor's cache.

    Bytes between two runs belong to the run before them and must have the value 0.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _HASHED_BYTES)))
        base, stop = int(starts[lo]), int(ends[hi - 1])
        begin = (starts[lo:hi] - base).astype(np.int32)
        if stop - base <= _POWERS:
            # Powers count from the first run of the block; each run's own begin is divided out.
            out[lo:hi] = np.add.reduceat(values[data[base:stop]] * _POW[: stop - base], begin) * _BACK[begin]
            lo = hi
            continue
        gaps = np.diff(begin, append=np.int32(stop - base))
        place = (np.arange(stop - base, dtype=np.int32) - np.repeat(begin, gaps)) & np.int32(_POWERS - 1)
        out[lo:hi] = np.add.reduceat(values[data[base:stop]] * _POW[place], begin)
        lo = hi
    return mixed(out)


def shingles(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``length`` words in text order, and for each text the index of its first run.

    A text with fewer words, but not none, has one run of all its words.
    """
    counts = np.diff(found.bounds)
    runs = np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    place = np.arange(bounds[-1]) + np.repeat(found.bounds[:-1] - bounds[:-1], runs)
    out = np.zeros(bounds[-1], dtype=np.uint64)
    size = np.repeat(np.minimum(counts, length), runs)
    if len(found.hashes):
        for k in range(length):
            held = found.hashes[np.minimum(place + k, len(found.hashes) - 1)] * _STEPS[k]
            out += np.where(k < size, held, 0).astype(np.uint64)
    return mixed(out + size.astype(np.uint64)), bounds


def lowered(text: bytes) -> bytes:
    """A-Z as a-z; every other byte stays."""
    return text.lower()
