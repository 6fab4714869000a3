"""Targets by repeated resharing, and what the mix takes."""

import re

import pytest

from tablewarden.llm.mixing import Mix, document_sizes, mixed_sources, source_targets
from tablewarden.llm.queries import op8_mixing

from .hard import empty_frame, hard_frame, on_disk

SMALL = "/root/testdata/sf0.01"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Give by weight, cap, and give the excess to the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {s: 0.0 for s in order}, share * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        given = {s: left * weight[s] / total for s in free}
        full = {s for s in free if given[s] >= most * sizes[s]}
        if not full:
            return out | given
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
    return out


def sizes_of(docs):
    out = {}
    for d in docs:
        out[d["source"]] = out.get(d["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    return out


def check(rows, docs, near):
    want = targets(sizes_of(docs))
    by_id = {d["doc_id"]: d for d in docs}
    taken = dict.fromkeys(want, 0)
    for r in rows:
        d = by_id[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        assert r["target"] == pytest.approx(want[d["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[d["source"]] += r["taken"]
    for source, n in taken.items():
        assert abs(n - want[source]) <= near, source
    return taken


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = op8_mixing(spark, SMALL).collect()
    largest = max(r["size"] for r in rows)
    check(rows, docs, largest / 2 + 1)
    again = op8_mixing(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_many_small_documents_and_null_source(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), None, None if i % 5 == 0 else "big" if i % 3 else f"s{i % 4}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, hard_frame(spark).schema)
    check(op8_mixing(spark, on_disk(df, tmp_path)).collect(), df.collect(), 5)


def test_smaller_budget_is_nested(spark):
    sizes = document_sizes(spark.read.parquet(f"{SMALL}/documents.parquet")).cache()
    less = {r["doc_id"]: r["copies"] for r in mixed_sources(sizes, Mix(share=0.4)).collect()}
    more = {r["doc_id"]: r["copies"] for r in mixed_sources(sizes, Mix(share=0.8)).collect()}
    assert all(more[k] >= n for k, n in less.items()) and sum(more.values()) > sum(less.values())


def test_hard_rows(spark, tmp_path):
    rows = op8_mixing(spark, on_disk(hard_frame(spark), tmp_path)).collect()
    assert len(rows) == hard_frame(spark).count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    same = [r["taken"] for r in rows if r["doc_id"] == 7 and r["size"] == 9]
    assert len(same) == 3 and len(set(same)) == 1
    assert mixed_sources(document_sizes(empty_frame(spark))).count() == 0
    assert mixed_sources(document_sizes(hard_frame(spark, extra=True))).count() == len(rows)


def test_sources_without_words(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 10), ("c", 0)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got == pytest.approx(targets({"a": 0, "b": 10, "c": 0}))
