"""Counts, cuts and budgets against the library that the vocabulary file is made for."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablewarden.llm.queries import VOCABULARY, op7_token_counts
from tablewarden.llm.texts import slices
from tablewarden.llm.token_counts import Counts, Prefixes, Vocabulary, token_counts

from .hard import HARD_TEXTS, empty_frame, hard_frame, on_disk

FILE = public_tokenizers.path(VOCABULARY)
PARTS = [" ", "  ", "\n", "\t", "a", "e", "th", "ing", "'", "'s", "'ll", "1", "22", "é", "ß", "日本", "😀", " ", "\x1c", "\x85", "​", "!", "--",
         "<|endoftext|>", "<|endof", "A", "aaaaaaaa", "́", "½", "Ⅷ", "　", "\0", "\r\n", "zqx"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counts():
    with open(FILE, encoding="utf-8") as f:
        return Counts(Vocabulary(f.read()))


def made(seed, count):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(count)]


def test_totals(counts, library):
    texts = made(1, 4000) + HARD_TEXTS
    assert [int(n) for part in slices(pa.array(texts, pa.string()), 5000) for n in counts.totals(part)] == [library(t) for t in texts]


def test_every_prefix_and_budget(counts, library):
    for text in [*made(2, 60), "x" * 300, "a " + " " * 200 + "b"]:
        prefixes, want = Prefixes(counts, text), [library(text[:i]) for i in range(len(text) + 1)]
        assert [prefixes.at(i) for i in range(len(text) + 1)] == want
        for budget in (0, 1, 2, 5, 9):
            longest = max(i for i, n in enumerate(want) if n <= budget)
            assert prefixes.longest(budget) == Prefixes(counts, text, budget).longest(budget) == longest


def test_given_table(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in op7_token_counts(spark, "/root/testdata/sf0.001").collect():
        text = docs[row["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), library(text))
        assert row["over_limit"] == (row["n_tokens"] > 512)
        assert library(text[: row["fit_chars"]]) <= 512


def test_hard_rows(spark, tmp_path, library):
    rows = op7_token_counts(spark, on_disk(hard_frame(spark), tmp_path)).collect()
    want = sorted(library(r["text"]) for r in hard_frame(spark).collect())
    assert sorted(r["n_tokens"] for r in rows) == want
    assert token_counts(empty_frame(spark), FILE).count() == 0
    clash = token_counts(hard_frame(spark, extra=True), FILE)
    assert clash.columns[-1] == "n_tokens_" and sorted(r["n_tokens_"] for r in clash.collect()) == want


def test_other_splitting_rules_are_refused(spark):
    other = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError, match="not supported"):
        token_counts(hard_frame(spark), other)


def test_kept_pairs_are_bounded(monkeypatch, library):
    monkeypatch.setattr("tablewarden.llm.token_counts.KEPT_PAIRS", 20)
    with open(FILE, encoding="utf-8") as f:
        counts = Counts(Vocabulary(f.read()))
    most = 0
    for text in made(7, 300):
        before = set(counts.vocabulary._beside)
        assert counts.total(text) == library(text)
        most = max(most, len(set(counts.vocabulary._beside) - before))
        # What was kept before a piece, and the pairs of the pieces of this text.
        assert len(counts.vocabulary._beside) <= 20 + 2 * most
