"""Components against all pairs on small tables; estimates against the truth."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewarden.llm.components import components
from tablewarden.llm.near_duplicates import Near, estimate, near_duplicates, signatures
from tablewarden.llm.paragraphs import repeated_paragraphs
from tablewarden.llm.queries import op5_near_duplicates
from tablewarden.llm.texts import shingles, slices, words

from .hard import empty_frame, hard_frame

SCHEMA = "doc_id bigint, text string"


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def chains(seed):
    """Groups of edited copies whose links are near the threshold, chains of them, exact copies and strangers."""
    r = random.Random(seed)
    make = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    docs = []
    for _ in range(8):
        text = make(r.randint(60, 200))
        docs += [edited(r, text, r.randint(0, 5)) for _ in range(12)] + [text.upper(), text.replace(" ", "\n")]
        for _ in range(6):
            text = edited(r, text, len(text.split()) // 45)
            docs.append(text)
    docs += [make(r.randint(1, 80)) for _ in range(60)]
    r.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = chains(seed)
    assert got(near_duplicates(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(op5_near_duplicates(spark, "/root/testdata/sf0.001")) == brute(docs)


def test_hard_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in hard_frame(spark).collect()]
    want = [(k, n, k if n == 0 else c) for k, n, c in brute(docs)]
    assert got(near_duplicates(hard_frame(spark, extra=True))) == sorted(want, key=repr)
    assert near_duplicates(empty_frame(spark)).count() == 0


def test_estimate_is_unbiased(spark):
    r = random.Random(3)
    text = " ".join(f"w{i}" for i in range(1000))
    near = Near()
    docs = [(i, edited(r, text, 30)) for i in range(40)]
    sets = {k: shingle_set(t) for k, t in docs}
    rows = signatures(spark.createDataFrame(docs, SCHEMA), near).select("doc_id", "signature")
    pairs = rows.toDF("a", "x").crossJoin(rows.toDF("b", "y")).where("a < b")
    errors = []
    for row in pairs.select("a", "b", estimate(F.col("x"), F.col("y"), near).alias("e")).collect():
        a, b = sets[row["a"]], sets[row["b"]]
        errors.append(row["e"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_hashes_do_not_depend_on_the_slice():
    texts = ["one two three four five six", "ONE two\tthree four five six", None, "x"] * 5
    for limit in (1, 40, 1 << 20):
        found = [words(part) for part in slices(pa.array(texts, pa.string()), limit)]
        rows = [tuple(w.hashes[w.bounds[i] : w.bounds[i + 1]]) for w in found for i in range(len(w.bounds) - 1)]
        assert rows[0] == rows[1] == rows[4] and rows[2] == () and len(set(rows)) == 3
        runs = [shingles(w, 5) for w in found]
        sizes = [int(n) for _, b in runs for n in np.diff(b)]
        assert sizes == [2, 2, 0, 1] * 5


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 70)] + [(200, 100)], "a bigint, b bigint")
    rows = {r["node"]: r["component"] for r in components(links).collect()}
    assert {rows[i] for i in range(71)} == {0} and rows[200] == 100


def test_repeated_paragraphs(spark):
    r = random.Random(8)
    passage = " ".join(f"p{r.randrange(500)}" for _ in range(60))
    filler = lambda: " ".join(f"f{r.randrange(10**6)}" for _ in range(50))
    docs = [(i, f"{filler()}\n{edited(r, passage, i % 2)}\n{filler()}") for i in range(6)]
    docs += [(10 + i, f"{filler()}\n{filler()}") for i in range(5)] + [(20, None), (21, ""), (22, f"{(own := filler())}\n{own}")]
    rows = repeated_paragraphs(spark.createDataFrame(docs, SCHEMA)).collect()
    texts = dict(docs)
    assert sorted((x["doc_id"], x["line"], x["first_doc_id"], x["removed"]) for x in rows) == [(i, 1, 0, i > 0) for i in range(6)]
    for x in rows:
        assert texts[x["doc_id"]][x["start"] : x["end"]] == texts[x["doc_id"]].split("\n")[1]
    assert repeated_paragraphs(empty_frame(spark)).count() == 0
    assert repeated_paragraphs(hard_frame(spark, extra=True)).count() == 0


@pytest.mark.parametrize("near", [Near(draws=0, small_bucket=2, block=7), Near(draws=1, small_bucket=3, block=1000), Near(draws=1)])
def test_large_buckets_in_blocks(spark, near):
    docs = chains(5)
    assert got(near_duplicates(spark.createDataFrame(docs, SCHEMA), near)) == brute(docs)
