"""Occurrences against string search, and the index against counting."""

import hashlib
import random
import re

import numpy as np
import pytest

from tablewarden.llm import decontamination
from tablewarden.llm.decontamination import decontaminated
from tablewarden.llm.fm_index import FMIndex
from tablewarden.llm.queries import op2_decontamination

from .hard import empty_frame, hard_frame

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(docs, items):
    windows = {}
    for name, text in items:
        words = WORD.findall(low(text))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if name is None else str(name))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        found = [(m.group(), *m.span()) for m in WORD.finditer(low(text))]
        words, hit, held = [f[0] for f in found], set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names:
                    hit |= set(range(i, i + size))
                    held |= names
        spans = []
        for i in sorted(hit):
            if spans and i - 1 in hit:
                spans[-1] = (spans[-1][0], found[i][2])
            else:
                spans.append(found[i][1:])
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(words), spans))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((*tuple(r)[:-1], [tuple(s) for s in r["spans"]]) for r in rows), key=repr)


def digest_columns(df):
    from pyspark.sql import functions as F

    return df.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated", "spans"
    ).collect()


def test_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = got(op2_decontamination(spark, SMALL).collect())
    assert rows == expected(docs, items)
    assert any(r[2] for r in rows)


@pytest.mark.parametrize("block", [500_000, 20])
def test_short_items_copies_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    r = random.Random(4)
    pool = ["aa", "b", "é", "dd1", "日本", "e"]
    make = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(1, make(30)), (2, "b"), (2, "é dd1 e"), (None, make(13)), (30, None), (4, "..!"), (5, make(5)), (6, "ABSENT words"), (7, make(14))]
    docs = [(i, make(r.randint(0, 80)) + r.choice(["", ".", "\n"])) for i in range(60)]
    docs += [(100 + i, f"x, {items[0][1].upper()}! y") for i in range(20)] + [(200, None), (201, ""), (None, "b"), (100, items[3][1])]
    out = decontaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert got(digest_columns(out)) == expected(docs, items)


def test_empty_and_clashing(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, "")], "item_id bigint, text string")
    assert decontaminated(empty_frame(spark), bench).count() == 0
    assert decontaminated(hard_frame(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    out = decontaminated(hard_frame(spark, extra=True), bench)
    assert out.count() == hard_frame(spark).count() and out.where("n_hit = 3").count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all(seed):
    r = np.random.default_rng(seed)
    symbols = r.integers(1, [2, 3, 5, 40, 300, 7][seed], 400 if seed else 1)
    index = FMIndex(symbols)
    lines = np.zeros((50, 6), dtype=np.int64)
    lengths = r.integers(1, 7, 50)
    for i, n in enumerate(lengths):
        at = r.integers(0, max(1, len(symbols) - n))
        line = symbols[at : at + n] if i % 3 else r.integers(1, 9, n)
        line = np.resize(line, n)
        lines[i, 6 - n :] = line
    low_, high = index.search(lines, lengths)
    for i, n in enumerate(lengths):
        want = [p for p in range(len(symbols) - n + 1) if (symbols[p : p + n] == lines[i, 6 - n :]).all()]
        assert sorted(index.locate(np.arange(low_[i], max(low_[i], high[i])))) == want
