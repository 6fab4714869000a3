"""Words and their forms against all pairs."""

import random
import re
import zlib
from collections import Counter

from tablewarden.llm.queries import op13_spelling
from tablewarden.llm.spelling import EQUAL, INSERTED, LONGER, REPLACED, SHORTER, letter_parts, signatures, spelling_variants, word_counts

from .hard import empty_frame, hard_frame, on_disk

SMALL = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(docs):
    out = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def expected(docs):
    n = counts(docs)
    # Words are one edit apart if they agree on a text with a gap: one letter left out of one or both.
    gaps = {}
    for w in n:
        for i in range(len(w)):
            gaps.setdefault(w[:i] + w[i + 1 :], []).append((w, i))
    near = {w: set() for w in n}
    for short, held in gaps.items():
        if short in n:
            for w, _ in held:
                near[w].add(short)
                near[short].add(w)
        for w, i in held:
            near[w] |= {v for v, k in held if v != w and i == k}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = got(spelling_variants(df))
    assert found == expected(docs)
    return found


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = got(op13_spelling(spark, SMALL))
    assert found == expected(docs)
    assert len(found) > 1000 and any(r[1] for r in found)


def test_hard_rows(spark, tmp_path):
    df = hard_frame(spark)
    tripled = df.union(df).union(df)
    docs = [tuple(r) for r in tripled.select("doc_id", "text").collect()]
    assert got(spelling_variants(tripled)) == expected(docs)
    assert got(op13_spelling(spark, on_disk(tripled, tmp_path))) == expected(docs)
    clashing = tripled
    for name in ("word", "n", "id", "run", "number", "signature", "near", "letters"):
        clashing = clashing.selectExpr("*", f"'clash' AS {name}")
    assert got(spelling_variants(clashing)) == expected(docs)
    assert spelling_variants(empty_frame(spark)).collect() == []


def test_edits_of_every_kind(spark):
    r = random.Random(3)
    letters = "aabbcdeéßÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(5, 14))) for _ in range(60)]
    # Equal letters next to each other, long words, words that share halves and letters.
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "x" * 3000 + "y" * 2000, "x" * 3000 + "y" * 1999, "x" * 2999 + "z" + "y" * 2000]
    for w in list(words[:60]):
        i = r.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]
    docs = [(i, " ".join(r.choices(words, k=400))) for i in range(30)] + [(None, " ".join(words * 3).upper())]
    found = check(spark, docs)
    assert sum(r[4] for r in found) > 200


def test_chains_end_at_the_root(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx", "abuvwzyx", "atuvwzyx"]
    docs = [(i, " ".join([w] * 3 * 2**k)) for k, w in enumerate(chain) for i in (1,)]
    found = check(spark, docs)
    assert {r[2] for r in found} == {chain[-1]}


def test_small_alphabet_pairs_are_whole(spark):
    # Every word of six letters over three letters: all words share halves and most letters.
    words = ["".join(p) for p in __import__("itertools").product("abc", repeat=6)]
    found = check(spark, [(i, " ".join(words)) for i in range(3)])
    assert len(found) >= 700


def test_frequent_words_meet_as_one_row(spark):
    df = spark.createDataFrame([(i, "common words common") for i in range(3000)], "doc_id bigint, text string").repartition(8)
    counted = word_counts(df)
    assert "partial_count" in counted._jdf.queryExecution().toString()
    for role, (parts, changed), size in ((EQUAL, REPLACED, 12), (SHORTER, INSERTED, 6), (LONGER, INSERTED, 6)):
        one = counted.where("word = 'common'")
        assert signatures(one, role, letter_parts(one, parts), changed).count() == size
