"""Language-model scores by a weighted backoff automaton that lives in tables.

Learning. Words and all runs of two and three words are counted over all training texts. A run is learned
if it occurs ``LEAST`` times, the same number for every corpus. Runs travel as numpy buffers: each unit
of texts sends to every bucket of contexts one message with its distinct runs and their counts, and a
bucket adds them up. The number of buckets follows the tokens, so that a bucket has a fixed size. A run of
three words belongs to the bucket of its first two. The buckets are filled in a few passes over the texts,
each for a range of them, as the messages of all would take several times the disk of the texts.

Model. P(w) = (c + 0.1) / (N + 0.1 (V + 1)); longer runs are discounted by a constant, and the mass left
in a context goes to the shorter one. Contexts are states, runs are arcs with log-probabilities, and each
state has a failure arc with its backoff weight to its longest shorter context. The table of the automaton
holds words and learned runs, keyed by ``code``: ``value``, the log-probability of an arc, and
``back``, the weight of the failure arc of the state it names (NaN where nothing follows it). It has a row
of numpy buffers per bucket. A bucket asks others only for what it lacks: the counts of its words, and the
probabilities of the last two words of its runs of three.

Scoring. A unit of texts asks the buckets of the table for the distinct codes that it holds. The answers
and the unit's words meet again, and the unit builds the part of the automaton that its texts can reach:
the states, the arcs out of each and the failure arcs. Every text is then traversed once from left to
right. The walk carries one state; it takes the arc of the next word where the state has one, and follows
failure arcs, adding their weights, until a state has one. The empty context has an arc for each word.
The texts of a unit walk at the same time, as numpy arrays.
Only counts pass the driver. Rows are scored in passes too, each over a part of them whose scores are written.

The words' part of the table is sent to several buckets, each for its own units, as a common word stands in
nearly all texts. A unit's own words travel by themselves, to buckets that hold about one unit each.

Defined cases: A-Z are a-z; 64-bit hashes stand for words and runs; a null text is empty and has the end
token only; rows whose id is null are neither learned from nor held out; rows that repeat are counted and
scored each; an empty table gives no rows, and without training texts all tokens are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import remove_scratch
from .tables import shipped, staged
from .texts import mixed, slices, words

#: Hash of the end token.
END = np.uint64(0x5A17E3C94D2B8F61)
#: Occurrences of a learned run.
LEAST = 2
#: Buckets of the words' table per bucket of runs.
WORD_BUCKETS = 16
#: Passes that count runs and passes that score rows, at most; a pass has ``PASS_BUCKETS`` buckets of runs at least.
COUNT_PASSES, SCORE_PASSES = 2, 7
PASS_BUCKETS = 4


@dataclass(frozen=True)
class Settings:
    """Words above ``share`` of all tokens, in runs of at least ``run_share`` of the training tokens, are learned; 0: all."""

    share: float = 0.0
    run_share: float = 0.0
    discount: float = 0.5
    add: float = 0.1
    folds: int = 10
    #: Words a worker counts before it passes its counts on, tokens of a unit, and tokens of a bucket.
    kept_words: int = 300_000
    unit_tokens: int = 4_000_000
    block: int = 1_000_000


def held_out(key: Column, folds: int) -> Column:
    """True for one fold, false for the others, null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % folds == 0


def part_of(key: Column, text: Column, parts: int) -> Column:
    """The pass that scores a row, from 0; the same in every reading of the rows."""
    return F.pmod(F.xxhash64(key.cast("string"), text), F.lit(parts))


@dataclass
class Unit:
    """Word hashes of some texts, each closed by the end token; and where the texts begin."""

    sequence: np.ndarray
    bounds: np.ndarray

    def starts(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words begin that lie inside a text."""
        inside, lengths = np.ones(len(self.sequence), dtype=bool), np.diff(self.bounds)
        for k in range(1, size):
            inside[self.bounds[1:][lengths >= k] - k] = False
        return np.flatnonzero(inside)


def _sequences(column: pa.Array) -> Iterator[tuple[int, int, Unit]]:
    """First and last text, and their words."""
    for part in slices(column):
        found = words(part)
        bounds = found.bounds + np.arange(len(found.bounds))
        out = np.full(bounds[-1], END, dtype=np.uint64)
        out[np.arange(len(found.hashes)) + np.repeat(np.arange(len(bounds) - 1), np.diff(found.bounds))] = found.hashes
        yield part.first, part.last, Unit(out, bounds)


def _joined(held: list[Unit]) -> Unit:
    at = np.cumsum([0, *(len(u.sequence) for u in held)])
    bounds = [u.bounds[:-1] + first for u, first in zip(held, at[:-1], strict=True)]
    return Unit(np.concatenate([u.sequence for u in held]), np.concatenate([*bounds, at[-1:]]))


_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def codes(*hashes: np.ndarray) -> np.ndarray:
    """Of runs, given the hashes of their first words, their second ones and so on."""
    out = np.full(len(hashes[0]), len(hashes), dtype=np.uint64)
    for hash_, step in zip(hashes, _STEPS, strict=False):
        out = mixed(out + hash_ * step)
    return out


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the code."""
    return ((code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_of(code: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(code, 32) * F.lit(buckets).cast("long"), 32).cast("int")


def _changes(*sorted_: np.ndarray) -> np.ndarray:
    """Places where any of the arrays has another value than before."""
    first = np.ones(len(sorted_[0]), dtype=bool)
    first[1:] = reduce(np.logical_or, (a[1:] != a[:-1] for a in sorted_))
    return np.flatnonzero(first)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted values among the sorted ones, and which of them there are."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


class Places:
    """Finds hashes among sorted ones: their first bits say where to begin, as hashes are spread evenly."""

    def __init__(self, sorted_: np.ndarray):
        bits = max(1, min(22, len(sorted_).bit_length()))
        self.sorted, self.shift = sorted_, np.uint64(64 - bits)
        counts = np.bincount((sorted_ >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = np.concatenate([[0], np.cumsum(counts)])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted hashes, -1 where there is none."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        first = (wanted >> self.shift).astype(np.int64)
        at, end = self.begin[first], self.begin[first + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        for _ in range(16):
            if not len(left):
                return out
            found = self.sorted[at]
            here = found == wanted
            out[left[here]] = at[here]
            at += 1
            more = np.flatnonzero((found < wanted) & (at < end))
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        # Only where many hashes begin alike.
        at, there = _find(self.sorted, wanted)
        out[left[there]] = at[there]
        return out


def _dealt(codes_: np.ndarray, of: int) -> Iterator[tuple[int, bytes]]:
    """Buckets of sorted codes, and the codes of each."""
    cut = np.searchsorted(_bucket(codes_, of), np.arange(of + 1))
    for k in np.flatnonzero(np.diff(cut)):
        yield int(k), codes_[cut[k] : cut[k + 1]].tobytes()


def _grouped(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An order by ``head`` in which equal pairs stand together; much faster than a sort by both."""
    bits = np.uint64(int(head.max(initial=1)).bit_length())
    key = (head.astype(np.uint64) << (np.uint64(64) - bits)) | (last >> bits)
    order = np.argsort(key)
    key, own = key[order], last[order]
    if np.any((key[1:] == key[:-1]) & (own[1:] != own[:-1])):
        return np.lexsort((last, head))
    return order


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """``word`` (its hash), ``c`` (in training texts), ``n`` (in all). ``docs``: (row, train, text, ...)."""

    def of(unit: Unit, train: np.ndarray) -> list[np.ndarray]:
        every = np.sort(unit.sequence)
        own = np.sort(unit.sequence[np.repeat(train, np.diff(unit.bounds))])
        first, at = _changes(every), _changes(own)
        c = np.zeros(len(first), dtype=np.int64)
        c[np.searchsorted(every[first], own[at])] = np.diff(at, append=len(own))
        return [every[first], c, np.diff(first, append=len(every))]

    def added(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        word, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word)
        at = _changes(word[order])
        return [word[order][at], _sums(c[order], at), _sums(n[order], at)]

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held], names=["word", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            train = np.array(batch.column(1).to_pylist(), dtype=bool)
            for first, last, unit in _sequences(batch.column(2)):
                held.append(of(unit, train[first:last]))
                size += len(held[-1][0])
                # Adding up costs a sort, so several slices are added at once.
                if size > 4 * settings.kept_words:
                    held = [added(held)]
                    size = len(held[0][0])
                    if size > settings.kept_words:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(added(held))

    partial = shipped(docs).mapInArrow(run, "word bigint, c bigint, n bigint")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _training_units(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[Unit]:
    held, size = [], 0
    for batch in batches:
        train = np.array(batch.column(1).to_pylist(), dtype=bool)
        for first, last, unit in _sequences(batch.column(2)):
            lengths, own = np.diff(unit.bounds), train[first:last]
            held.append(Unit(unit.sequence[np.repeat(own, lengths)], np.concatenate([[0], np.cumsum(lengths[own])])))
            size += len(held[-1].sequence)
            if size >= tokens:
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


_MESSAGE = {"a": np.uint64, "b": np.uint64, "n": np.uint32, "head": np.uint32, "last": np.uint64, "m": np.uint32}


def _messages(buckets: int, low: int, high: int, tokens: int):
    """Per unit and bucket from ``low`` to below ``high``: distinct pairs (``a``, ``b``, count ``n``), and triples as their pair's place, ``last`` word, count ``m``."""

    def of(unit: Unit) -> pa.RecordBatch | None:
        at = unit.starts(2)
        code = codes(unit.sequence[at], unit.sequence[at + 1])
        if high - low < buckets:
            bucket = _bucket(code, buckets)
            own = (bucket >= low) & (bucket < high)
            at, code = at[own], code[own]
        if not len(at):
            return None
        order = np.argsort(code)
        code = code[order]
        first = _changes(code)
        place = np.empty(len(at), dtype=np.uint32)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(at)))
        begin = at[order[first]]
        held = {"a": unit.sequence[begin], "b": unit.sequence[begin + 1], "n": np.diff(first, append=len(at))}
        cut = np.searchsorted(_bucket(code[first], buckets), np.arange(low, high + 1))
        inside = np.zeros(len(unit.sequence), dtype=bool)
        inside[at] = True
        three = unit.starts(3)
        three = three[inside[three]]
        head, last = place[np.searchsorted(at, three)], unit.sequence[three + 2]
        order = _grouped(head, last)
        head, last = head[order], last[order]
        first = _changes(head, last)
        held |= {"head": head[first], "last": last[first], "m": np.diff(first, append=len(head))}
        cuts = {"abn": cut, "hlm": np.searchsorted(head[first], cut)}
        filled = np.flatnonzero(np.diff(cut))
        columns = []
        for name, kind in _MESSAGE.items():
            edges = cuts["abn" if name in "abn" else "hlm"]
            # Places of pairs count from the first pair of the message.
            parts = [held[name][edges[k] : edges[k + 1]] - (cut[k] if name == "head" else 0) for k in filled]
            columns.append(pa.array([x.astype(kind).tobytes() for x in parts], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array((low + filled).astype(np.int32)), *columns], names=["bucket", *_MESSAGE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _training_units(batches, tokens):
            if (out := of(unit)) is not None:
                yield out

    return run


def _buffers(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in table[name].to_pylist()]


def _all(table: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    """Each column's buffers, one after the other."""
    return {name: np.concatenate([np.zeros(0, kind), *_buffers(table, name, kind)]) for name, kind in kinds.items()}


def _row(bucket: int, kinds: dict, held: dict[str, np.ndarray]) -> pa.Table:
    """One row of the bucket's buffers."""
    columns = {name: pa.array([held[name].astype(kind).tobytes()], pa.binary()) for name, kind in kinds.items()}
    return pa.table({"bucket": pa.array([bucket], pa.int32())} | columns)


def _columns(kinds: dict, *before: str) -> str:
    return ", ".join([*(f"{name} int" for name in (*before, "bucket")), *(f"{name} binary" for name in kinds)])


#: Learned runs of a bucket: pairs in the order of their codes, and triples, by pair, as the pair's place and ``last`` word; with their counts.
_RUNS = {"a": np.uint64, "b": np.uint64, "c": np.int64, "head": np.uint32, "last": np.uint64, "m": np.int64}


def _merged(least: float):
    def run(table: pa.Table) -> pa.Table:
        held = {name: _buffers(table, name, kind) for name, kind in _MESSAGE.items()}
        before = np.cumsum([0, *(len(x) for x in held["a"])])
        head = np.concatenate([x + first for x, first in zip(held["head"], before[:-1], strict=True)])
        a, b, n, last, m = (np.concatenate(held[name]) for name in ("a", "b", "n", "last", "m"))
        code = codes(a, b)
        order = np.argsort(code)
        first = _changes(code[order])
        place = np.empty(len(code), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(code)))
        a, b, pairs = a[order[first]], b[order[first]], _sums(n[order].astype(np.int64), first)
        # The first two words of a learned triple are a learned pair.
        head, two = place[head], pairs >= least
        able = two[head]
        head, last, m = head[able], last[able], m[able]
        order = _grouped(head, last)
        head, last = head[order], last[order]
        first = _changes(head, last)
        triples = _sums(m[order].astype(np.int64), first)
        head, last = head[first], last[first]
        three = triples >= least
        out = {"a": a[two], "b": b[two], "c": pairs[two], "head": (np.cumsum(two) - 1)[head[three]], "last": last[three], "m": triples[three]}
        return _row(table["bucket"][0].as_py(), _RUNS, out)

    return run


def learned_runs(docs: DataFrame, settings: Settings, buckets: int, least: float, low: int, high: int) -> DataFrame:
    """All runs that occur ``least`` times of the buckets from ``low`` to below ``high``, a row per bucket."""
    texts = docs.where("train").select("row", "train", "text")
    messages = shipped(texts).mapInArrow(_messages(buckets, low, high, settings.unit_tokens // 2), _columns(_MESSAGE))
    return messages.groupBy("bucket").applyInArrow(_merged(least), _columns(_RUNS))


#: Learned runs whose words are numbered, with the counts of the first (``of``) and the second word (``tail``) of a pair.
_COUNTED = _RUNS | {"of": np.int64, "tail": np.int64}


def _word_questions(words_: int):
    """Per bucket of runs and of words: the distinct words of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, *own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                every = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in own]))
                found = list(_dealt(every[_changes(every)], words_))
                columns = [pa.array([k for k, _ in found], pa.int32()), pa.array([bucket] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "bucket", "codes"])

    return run


def _word_answers(asked: pa.Table, counts: pa.Table) -> pa.Table:
    word, c = counts["word"].to_numpy().view(np.uint64), counts["c"].to_numpy()
    order = np.argsort(word)
    word, c = word[order], c[order]
    out = {"codes": [], "c": []}
    for own in _buffers(asked, "codes", np.uint64):
        at, there = _find(word, own)
        out["codes"].append(own[there].tobytes())
        out["c"].append(c[at[there]].astype(np.int64).tobytes())
    return pa.table({"bucket": asked["bucket"]} | {name: pa.array(x, pa.binary()) for name, x in out.items()})


def _with_counts(runs: pa.Table, answers: pa.Table) -> pa.Table:
    own, known = _all(runs, _RUNS), _all(answers, {"codes": np.uint64, "c": np.int64})
    order = np.argsort(known["codes"])
    word, c = known["codes"][order], known["c"][order]
    (of, first), (tail, second) = _find(word, own["a"]), _find(word, own["b"])
    two = first & second
    three = two[own["head"]]
    out = {name: own[name][two] for name in ("a", "b", "c")} | {name: own[name][three] for name in ("last", "m")}
    out |= {"head": (np.cumsum(two) - 1)[own["head"][three]], "of": c[of[two]], "tail": c[tail[two]]}
    return _row(runs["bucket"][0].as_py(), _COUNTED, out)


def counted_runs(runs: DataFrame, counts: DataFrame, words_: int) -> DataFrame:
    """The runs of ``counts``' words, with the counts of these. ``counts``: (place, word, c), ``place`` one of ``words_`` buckets."""
    asked = runs.select("bucket", "a", "b").mapInArrow(_word_questions(words_), "place int, bucket int, codes binary")
    answers = asked.groupBy("place").cogroup(counts.groupBy("place")).applyInArrow(_word_answers, "bucket int, codes binary, c binary")
    return runs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_with_counts, _columns(_COUNTED))


def _left(p: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Backoff weight: log10 of the mass left by the continuations of a context over what they have in the shorter one."""
    return np.log10(np.maximum(1 - p, 1e-300) / np.maximum(1 - shorter, 1e-300))


@dataclass(frozen=True)
class Model:
    """Probabilities from counts; ``mass`` is what the counts of all words and of an unknown one add up to."""

    discount: float
    add: float
    mass: float

    def single(self, c: np.ndarray) -> np.ndarray:
        return (c + self.add) / self.mass

    def longer(self, c: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (c - self.discount) / of


#: Continuations of words: their sums of probabilities, in the context of the word and without it.
_FOLLOWED = {"codes": np.uint64, "p": np.float64, "shorter": np.float64}
#: The table of the automaton.
_TABLE = {"codes": np.uint64, "value": np.float64, "back": np.float64, "known": np.uint8}


def _table_row(bucket: int, *held: np.ndarray) -> pa.Table:
    """One row of the table, its codes sorted."""
    order = np.argsort(held[0])
    return _row(bucket, _TABLE, {name: values[order] for name, values in zip(_TABLE, held, strict=True)})


def _followed(model: Model, words_: int):
    """Per bucket of runs and of words: ``_FOLLOWED`` of the first words of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                own = _all(table.slice(i, 1), {name: _COUNTED[name] for name in ("a", "c", "of", "tail")})
                order = np.argsort(own["a"])
                word = own["a"][order]
                first = _changes(word)
                sums = [_sums(x[order], first) for x in (model.longer(own["c"], own["of"]), model.single(own["tail"]))]
                cut = np.searchsorted(_bucket(word[first], words_), np.arange(words_ + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    held = dict(zip(_FOLLOWED, (x[cut[k] : cut[k + 1]] for x in (word[first], *sums)), strict=True))
                    yield from _row(int(k), _FOLLOWED, held).to_batches()

    return run


def _word_states(model: Model):
    def run(counts: pa.Table, followed: pa.Table) -> pa.Table:
        word, c = counts["word"].to_numpy().view(np.uint64), counts["c"].to_numpy()
        held = _all(followed, _FOLLOWED)
        order = np.argsort(held["codes"])
        head = held["codes"][order]
        first = _changes(head)
        sums = [_sums(held[name][order], first) for name in ("p", "shorter")]
        at, there = _find(head[first], word)
        back = np.full(len(word), np.nan)
        back[there] = _left(*sums)[at[there]]
        return _table_row(counts["place"][0].as_py(), word, np.log10(model.single(c)), back, c > 0)

    return run


def _pair_values(model: Model):
    """Per bucket the codes of its pairs and their probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                own = _all(table.slice(i, 1), {name: _COUNTED[name] for name in ("a", "b", "c", "of")})
                values = {"codes": codes(own["a"], own["b"]), "p": model.longer(own["c"], own["of"])}
                yield from _row(table["bucket"][i].as_py(), {"codes": np.uint64, "p": np.float64}, values).to_batches()

    return run


def _tail_questions(buckets: int):
    """Per bucket and bucket asked: the codes of the last two words of its triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                own = _all(table.slice(i, 1), {name: _COUNTED[name] for name in ("b", "head", "last")})
                tails = np.sort(codes(own["b"][own["head"]], own["last"]))
                found = list(_dealt(tails[_changes(tails)], buckets))
                columns = {
                    "asked": pa.array([k for k, _ in found], pa.int32()),
                    "bucket": pa.array([table["bucket"][i].as_py()] * len(found), pa.int32()),
                    "codes": pa.array([x for _, x in found], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _tail_answers(asked: pa.Table, values: pa.Table) -> pa.Table:
    held = _all(values, {"codes": np.uint64, "p": np.float64})
    out = {"codes": [], "p": []}
    for own in _buffers(asked, "codes", np.uint64):
        at, there = _find(held["codes"], own)
        out["codes"].append(own[there].tobytes())
        out["p"].append(held["p"][at[there]].tobytes())
    return pa.table({"bucket": asked["bucket"]} | {name: pa.array(x, pa.binary()) for name, x in out.items()})


def _arcs(model: Model):
    """Arcs of a bucket's runs, and the backoff weights of its pairs."""

    def run(runs: pa.Table, answers: pa.Table) -> pa.Table:
        own, known = _all(runs, _COUNTED), _all(answers, {"codes": np.uint64, "p": np.float64})
        order = np.argsort(known["codes"])
        head, last = own["head"], own["last"]
        at, there = _find(known["codes"][order], codes(own["b"][head], last))
        head, last = head[there], last[there]
        p, shorter = model.longer(own["m"][there], own["c"][head]), known["p"][order][at[there]]
        first = _changes(head)
        back = np.full(len(own["a"]) + len(head), np.nan)
        back[head[first]] = _left(_sums(p, first), _sums(shorter, first))
        code = np.concatenate([codes(own["a"], own["b"]), codes(own["a"][head], own["b"][head], last)])
        value = np.log10(np.concatenate([model.longer(own["c"], own["of"]), p]))
        return _table_row(runs["bucket"][0].as_py(), code, value, back, np.zeros(len(code)))

    return run


def automaton(counts: DataFrame, runs: list[DataFrame], model: Model, buckets: Buckets, made: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The table's part of words, and those of the runs, given these with their words' counts; a row per bucket.

    Paths of the tables are added to ``made``.
    """
    every = reduce(DataFrame.union, runs)
    followed = every.select("bucket", "a", "c", "of", "tail").mapInArrow(_followed(model, buckets.words), _columns(_FOLLOWED))
    of_words = counts.groupBy("place").cogroup(followed.groupBy("bucket")).applyInArrow(_word_states(model), _columns(_TABLE))
    out = staged(of_words, "words", made), []
    for part in runs:
        values = every.select("bucket", "a", "b", "c", "of").mapInArrow(_pair_values(model), "bucket int, codes binary, p binary")
        asked = part.select("bucket", "b", "head", "last").mapInArrow(_tail_questions(buckets.runs), "asked int, bucket int, codes binary")
        answers = asked.groupBy("asked").cogroup(values.groupBy("bucket")).applyInArrow(_tail_answers, "bucket int, codes binary, p binary")
        of_runs = part.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_arcs(model), _columns(_TABLE))
        out[1].append(staged(of_runs, "arcs", made))
    return out


@dataclass(frozen=True)
class Buckets:
    """Of runs; of words by their hash, and copies of each. Buckets of whole units follow, as many as of runs."""

    runs: int
    words: int
    copies: int

    @property
    def of_units(self) -> int:
        return self.runs + self.words * self.copies

    def of_table(self, of_words: DataFrame, of_runs: list[DataFrame]) -> DataFrame:
        copy = F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1)))
        placed = of_words.select("*", copy.alias("copy")).select((self.runs + F.col("bucket") * self.copies + F.col("copy")).cast("int").alias("bucket"), *_TABLE)
        return reduce(DataFrame.union, of_runs, placed)

    def passes(self, most: int) -> int:
        return min(most, self.runs // PASS_BUCKETS + 1)


#: What a unit sends: to a bucket of the table its distinct codes, and once its distinct words, its texts as places among them and their heads.
_QUESTION = {"codes": np.uint64, "words": np.uint64, "texts": np.uint32}


def _run_questions(unit: Unit, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Buckets of the distinct runs of two and three words, and the codes of each; sorting is much faster here than the hashing of ``np.unique``."""
    at = unit.starts(2)
    pair = np.zeros(len(unit.sequence), dtype=np.uint64)
    pair[at] = codes(unit.sequence[at], unit.sequence[at + 1])
    two = np.sort(pair[at])
    two = two[_changes(two)]
    at = unit.starts(3)
    three = codes(*[unit.sequence[at + k] for k in range(3)])
    order = np.argsort(three)
    order = order[_changes(three[order])]
    code, bucket = np.concatenate([two, three[order]]), _bucket(np.concatenate([two, pair[at[order]]]), buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    code = code[order]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cut)):
        yield int(k), code[cut[k] : cut[k + 1]].tobytes()


def _questions(buckets: Buckets, tokens: int, heads_type: pa.DataType):
    """Per unit and bucket: ``unit``, the number of its first row, and the columns of ``_QUESTION``."""

    def of(held: list[Unit], rows: list[np.ndarray], heads: list[pa.Array]) -> pa.RecordBatch:
        unit, first = _joined(held), int(rows[0][0])
        distinct = np.sort(unit.sequence)
        distinct = distinct[_changes(distinct)]
        places = Places(distinct).find(unit.sequence)
        copy = first % buckets.copies
        found = list(_run_questions(unit, buckets.runs))
        found += [(buckets.runs + k * buckets.copies + copy, own) for k, own in _dealt(distinct, buckets.words)]
        number = [k for k, _ in found] + [buckets.of_units + int(mixed(np.array([first], np.uint64))[0] % np.uint64(buckets.runs))]
        without = [None] * len(found)
        values = pa.concat_arrays(heads)
        lists = pa.ListArray.from_arrays(pa.array([0] * (len(found) + 1) + [len(values)], pa.int32()), values).cast(heads_type)
        columns = {
            "bucket": pa.array(number, pa.int32()),
            "unit": pa.array([first] * len(number), pa.int64()),
            "codes": pa.array([*(own for _, own in found), None], pa.binary()),
            "words": pa.array([*without, distinct.tobytes()], pa.binary()),
            "texts": pa.array([*without, places.astype(np.uint32).tobytes()], pa.binary()),
            "heads": lists,
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, heads, size = [], [], [], 0
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for first, last, unit in _sequences(batch.column(2)):
                held.append(unit)
                rows.append(numbers[first:last])
                own = slice(first, last)
                fields = [batch.column(3)[own], batch.column(4)[own], pa.array(np.diff(unit.bounds), pa.int64())]
                heads.append(pa.StructArray.from_arrays(fields, names=["doc_id", "held_out", "n_tokens"]))
                size += len(unit.sequence)
                if size >= tokens:
                    yield of(held, rows, heads)
                    held, rows, heads, size = [], [], [], 0
        if held:
            yield of(held, rows, heads)

    return run


def _answers(asked: pa.Table, table: pa.Table) -> pa.Table:
    """The entries of the automaton's table that each unit asked a bucket for. What a unit sent for itself passes unchanged."""
    of = _all(table, _TABLE)
    out = {name: [] for name in _TABLE}
    for own in _buffers(asked, "codes", np.uint64):
        at, there = _find(of["codes"], own)
        for name, values in of.items():
            out[name].append(values[at[there]].tobytes())
    columns = [pa.array(held, pa.binary()) for held in out.values()]
    return pa.Table.from_arrays([asked["unit"], *columns, asked["words"], asked["texts"], asked["heads"]], names=["unit", *_TABLE, "words", "texts", "heads"])


class Automaton:
    """Part of the automaton that some texts can reach.

    State 0 is the empty context; then come the words, and the pairs, of which those are used that are
    contexts. ``first`` and ``after`` are the arcs of state 0: log-probability of a word and the state after
    it. ``failure`` and ``weight`` are the failure arcs. The arcs of other states lie along the texts: at each
    place ``from_word`` and ``from_pair`` have the state whose arc reads the word there (-1: there is none),
    ``by_word`` and ``by_pair`` its log-probability, and ``then`` is the state after both.
    """

    def __init__(self, words_: np.ndarray, unit: Unit, places: np.ndarray, known: dict[str, np.ndarray]):
        order = np.argsort(known["codes"])
        table, value, back = Places(known["codes"][order]), known["value"][order], known["back"][order]
        at = table.find(words_)
        size, length = len(words_), len(places)
        self.places = places
        self.first, self.known = value[at], known["known"][order][at]
        self.after = np.where(np.isnan(back[at]), 0, 1 + np.arange(size))
        self.failure = np.zeros(1 + size + len(value), dtype=np.int64)
        self.weight = np.concatenate([[0.0], np.nan_to_num(back[at]), np.nan_to_num(back)])
        self.from_word, self.from_pair = np.full(length, -1), np.full(length, -1)
        self.by_word, self.by_pair = np.zeros(length), np.zeros(length)
        self.then = self.after[places]

        sequence = unit.sequence
        begin = unit.starts(2)
        of_pair = np.full(length, -1, dtype=np.int64)
        of_pair[begin + 1] = table.find(codes(sequence[begin], sequence[begin + 1]))
        last = np.flatnonzero(of_pair >= 0)
        row = of_pair[last]
        self.from_word[last], self.by_word[last] = 1 + places[last - 1], value[row]
        context = ~np.isnan(back[row])
        last, row = last[context], row[context]
        self.failure[1 + size + row] = self.then[last]
        self.then[last] = 1 + size + row

        last = unit.starts(3) + 2
        last = last[(self.from_word[last] >= 0) & (self.then[last - 1] > size)]
        row = table.find(codes(sequence[last - 2], sequence[last - 1], sequence[last]))
        last, row = last[row >= 0], row[row >= 0]
        self.from_pair[last], self.by_pair[last] = self.then[last - 1], value[row]

    def walk(self, bounds: np.ndarray) -> np.ndarray:
        """Sums of the log-probabilities of the texts, each traversed once from left to right; all walk at the same time.

        A word is read from the state to which the word before it led, the first one of a text from state 0.
        Failure arcs are followed, their weights added, until a state has an arc for the word.
        """
        state = np.concatenate([[0], self.then[:-1]])
        state[bounds[:-1]] = 0
        at, score = np.arange(len(state)), np.zeros(len(state))
        while len(at):
            pair, word = self.from_pair[at] == state, self.from_word[at] == state
            taken = pair | word | (state == 0)
            other = np.where(taken, self.first[self.places[at]], self.weight[state])
            score[at] += np.where(pair, self.by_pair[at], np.where(word, self.by_word[at], other))
            left = np.flatnonzero(~taken)
            at, state = at[left], self.failure[state[left]]
        # The end token closes each text, so none is empty.
        return _sums(score, bounds[:-1])


def _walked(answers: pa.Table) -> pa.Table:
    """Of one unit: the texts' heads with known words, base score and score."""
    own = next(i for i, x in enumerate(answers["texts"].to_pylist()) if x is not None)
    heads = answers["heads"][own].values
    words_ = np.frombuffer(answers["words"][own].as_py(), np.uint64)
    places = np.frombuffer(answers["texts"][own].as_py(), np.uint32).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(heads.field(2).to_numpy())])
    automaton_ = Automaton(words_, Unit(words_[places], bounds), places, _all(answers, _TABLE))
    # The end token closes each text, so none is empty.
    base = _sums(automaton_.first[places], bounds[:-1])
    n_known = _sums(automaton_.known[places].astype(np.int64), bounds[:-1])
    columns = [heads.field(i) for i in range(3)] + [pa.array(n_known), pa.array(base), pa.array(automaton_.walk(bounds))]
    return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def language_model_scores(df: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    out_of = held_out(F.col(key), settings.folds)
    docs = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(~out_of, F.lit(False)).alias("train"),
        F.col(text).alias("text"),
        F.col(key).alias("doc_id"),
        F.coalesce(out_of, F.lit(False)).alias("held_out"),
    )
    spark = df.sparkSession
    made: list[str] = []
    counts = staged(word_counts(docs.select("row", "train", "text"), settings), "word-counts", made)
    total, every, vocabulary, distinct = counts.agg(F.sum("c"), F.sum("n"), F.count(F.when(F.col("c") > 0, 1)), F.count(F.lit(1))).first()
    total, every = total or 0, every or 0
    blocks = every // settings.block + 1
    of_words = distinct // settings.block + 1
    buckets = Buckets(blocks, of_words, max(1, blocks // WORD_BUCKETS // of_words))
    model = Model(settings.discount, settings.add, total + settings.add * (vocabulary + 1))
    placed = counts.select(bucket_of(F.col("word"), of_words).alias("place"), "word", "c", "n")
    frequent = placed.where((F.col("n") > settings.share * every) | (F.col("word") == int(END.view(np.int64)))) if settings.share else placed
    numbered = frequent.select("place", "word", "c")

    least = max(LEAST, settings.run_share * total)
    passes = buckets.passes(COUNT_PASSES)
    runs = []
    for k in range(passes):
        found: list[str] = []
        own = staged(learned_runs(docs, settings, blocks, least, blocks * k // passes, blocks * (k + 1) // passes), "runs", found)
        runs.append(staged(counted_runs(own, numbered, of_words), "counted-runs", made))
        remove_scratch(spark, found)
    parts: list[str] = []
    table = buckets.of_table(*automaton(placed.select("place", "word", "c"), runs, model, buckets, parts))
    # What only led to the table goes before texts are scored.
    remove_scratch(spark, made)

    head = F.struct("doc_id", "held_out", F.lit(0).cast("bigint").alias("n_tokens"))
    # A condition keeps Spark from declaring the lists as never null.
    heads = F.when(F.col("row") >= 0, F.array(F.when(F.col("row") >= 0, head)))
    binary = lambda names: [F.lit(None).cast("binary").alias(name) for name in names]
    asking = docs.select(F.lit(0).alias("bucket"), F.col("row").alias("unit"), *binary(_QUESTION), heads.alias("heads")).schema
    answering = docs.select(F.col("row").alias("unit"), *binary([*_TABLE, "words", "texts"]), heads.alias("heads")).schema
    numbers = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    scored = docs.select("doc_id", "held_out", *[F.lit(0).cast(kind).alias(name) for name, kind in numbers.items()]).schema
    ask = _questions(buckets, settings.unit_tokens // 4, to_arrow_type(asking["heads"].dataType))
    passes = buckets.passes(SCORE_PASSES)
    rows = []
    for k in range(passes):
        own = docs.where(part_of(F.col("doc_id"), F.col("text"), passes) == k) if passes > 1 else docs
        asked = shipped(own).mapInArrow(ask, asking)
        answers = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_answers, answering)
        rows.append(staged(answers.groupBy("unit").applyInArrow(_walked, scored), "scores"))
    remove_scratch(spark, parts)
    return reduce(DataFrame.union, rows).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
