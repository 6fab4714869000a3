"""Counts, base scores and the walk against a plain backoff model in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewarden.llm import language_model
from tablewarden.llm.language_model import Settings, language_model_scores
from tablewarden.llm.queries import op10_language_model
from tablewarden.sources.scratch import scratch_copies

from .hard import empty_frame, hard_frame, random_texts

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


class Plain:
    def __init__(self, docs, settings):
        texts = [tokens(t) for k, t in docs if k is not None and zlib.crc32(str(k).encode()) % 10 != 0]
        every = Counter(w for _, t in docs for w in tokens(t))
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        numbered = {w for w, n in every.items() if n > settings.share * sum(every.values())} | {"\n"}
        self.d = settings.discount
        self.kept = {}
        for size in (2, 3):
            counts = Counter(tuple(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
            least = max(2.0, settings.run_share * self.n)
            self.kept[size] = {g: n for g, n in counts.items() if n >= least and numbered.issuperset(g)}
        self.after = {}
        for held in self.kept.values():
            for g in held:
                self.after.setdefault(g[:-1], []).append(g[-1])
        self.rest = {}

    def p(self, word, context=()):
        if not context:
            return (self.c[word] + 0.1) / (self.n + 0.1 * (self.v + 1))
        if context not in self.after:
            return self.p(word, context[1:])
        own = self.kept[len(context) + 1]
        of = self.c[context[0]] if len(context) == 1 else self.kept[2][context]
        if (*context, word) in own:
            return (own[(*context, word)] - self.d) / of
        if context not in self.rest:
            left = 1 - sum((own[(*context, w)] - self.d) / of for w in self.after[context])
            self.rest[context] = left / (1 - sum(self.p(w, context[1:]) for w in self.after[context]))
        return self.rest[context] * self.p(word, context[1:])

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t))


def check(rows, docs, settings=Settings()):
    plain = Plain(docs, settings)
    want = []
    for key, text in docs:
        t = tokens(text)
        want.append(
            (key, key is not None and zlib.crc32(str(key).encode()) % 10 == 0, len(t), sum(plain.c[w] > 0 for w in t), plain.n,
             sum(math.log10(plain.p(w)) for w in t), plain.score(text))
        )
    got = sorted((tuple(r) for r in rows), key=lambda r: repr((r[:5], round(r[6], 4))))
    want = sorted(want, key=lambda r: repr((r[:5], round(r[6], 4))))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return plain, got


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    _, got = check(op10_language_model(spark, SMALL).collect(), docs)
    # The model knows more than word frequencies, also about texts that it has not seen.
    unseen = [r for r in got if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


@pytest.mark.parametrize("settings", [Settings(share=0.004, run_share=0.002, block=7, unit_tokens=50, kept_words=5), Settings(share=0.02)])
def test_small_shares_units_and_blocks(spark, settings):
    docs = list(enumerate(random_texts(150, 9)))
    docs += [(7, "again a b c a b c a b c"), (None, "a b c"), (None, None), (11, ""), (11, "Ü É e")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    plain, _ = check(language_model_scores(df, settings).collect(), docs, settings)
    for context in random.Random(1).sample(sorted(plain.after), min(20, len(plain.after))):
        assert sum(plain.p(w, context) for w in plain.c) + plain.p("never seen", context) == pytest.approx(1)


def test_empty_hard_and_extra(spark):
    assert language_model_scores(empty_frame(spark)).count() == 0
    rows = language_model_scores(hard_frame(spark, extra=True)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in hard_frame(spark).collect()])


def test_rare_runs_are_learned_in_a_large_corpus(spark):
    # Two sightings among 600,000 tokens, less than 2^-18 of them.
    filler = [" ".join(f"f{(i * 7 + k) % 50}" for k in range(3000)) for i in range(200)]
    docs = [*enumerate(filler), *((1000 + i, "rare phrase here") for i in range(40))]
    learned = [k for k, t in docs if k >= 1000 and zlib.crc32(str(k).encode()) % 10 != 0]
    docs = [(k, t) for k, t in docs if k < 1000 or k in learned[:2]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in language_model_scores(df).collect()}
    assert all(rows[k]["score"] > rows[k]["base_score"] + 5 for k in learned[:2])
    # Sizes of units and buckets change nothing.
    small = {r["doc_id"]: r for r in language_model_scores(df.repartition(3), Settings(block=20_000, unit_tokens=40_000)).collect()}
    assert all(small[k]["score"] == pytest.approx(rows[k]["score"], rel=1e-9) for k in rows)


def test_passes_share_out_the_shuffled_data(spark):
    # Each pass sends its share of the messages, and together they are those of one pass.
    texts = random_texts(300, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([True] * 300), pa.array(texts, pa.string())], names=["row", "train", "text"])

    def sent(low, high):
        return [row for out in language_model._messages(12, low, high, 10_000)([batch]) for row in out.to_pylist()]

    whole, passes = sent(0, 12), [sent(k, k + 4) for k in (0, 4, 8)]
    order = lambda rows: sorted(rows, key=lambda r: (r["bucket"], r["a"], r["last"]))
    assert order(whole) == order([row for own in passes for row in own])
    size = lambda rows: sum(len(x) for r in rows for x in r.values() if isinstance(x, bytes))
    assert max(map(size, passes)) < size(whole) / 2
    # A row, null or not, is scored in one pass; passes have about as many rows each.
    keys = spark.createDataFrame([*enumerate(texts * 4), (None, "a b"), (None, None), (7, None)], "doc_id bigint, text string")
    parts = keys.groupBy(language_model.part_of(keys["doc_id"], keys["text"], 4).alias("part")).count().collect()
    assert sorted(r["part"] for r in parts) == [0, 1, 2, 3] and sum(r["count"] for r in parts) == 1203
    assert max(r["count"] for r in parts) < 400


def test_scoring_leaves_only_scores_behind(spark):
    # Tables and messages of a pass are gone when it ends; none is left for the one who reads the scores.
    before = scratch_copies(spark)
    docs = list(enumerate(random_texts(60, 5)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = language_model_scores(df, Settings(block=40, unit_tokens=200))
    left = [path for path in scratch_copies(spark) if path not in before]
    assert len(left) == language_model.SCORE_PASSES and all("/scores-" in path for path in left)
    check(rows.collect(), docs)


def test_runs_that_share_the_first_bits_of_their_last_word():
    head = np.array([1, 0, 1, 0, 1], dtype=np.int64)
    last = np.array([5, 4, 6, 4, 5], dtype=np.uint64)
    order = language_model._grouped(head, last)
    assert [(int(head[i]), int(last[i])) for i in order] == [(0, 4), (0, 4), (1, 5), (1, 5), (1, 6)]
