"""Licence places against a search of every text from every place."""

import random
import re

from tablewarden.llm.licences import DOUBT, SHARE, TEMPLATES, document_frequencies, license_scans, positional_index
from tablewarden.llm.queries import op12_licenses

from .hard import empty_frame, hard_frame

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected_row(text):
    words = words_of(text)
    held = []
    for t in TEMPLATES:
        size = len(t.words)
        for start in range(-size, len(words)):
            equal = [0 <= start + k < len(words) and words[start + k] == t.words[k] for k in range(size)]
            if all(e for e, key in zip(equal, t.key) if key) and sum(equal) / size >= SHARE:
                held.append((start, t.label, size, sum(equal) / size, t.base))
    held.sort()
    base = [m for m in held if m[4]]
    labels = lambda found: ",".join(sorted({m[1] for m in found}))
    score = max((m[3] * m[2] / (m[2] + DOUBT) for m in held), default=0.0)
    ends = (base[0][0], base[-1][0]) if base else (None, None)
    return (len(words), len(base), *ends, labels(base), labels(held), score, [(m[1], m[0], m[2], m[3]) for m in held])


def got(df):
    return sorted(((*tuple(r)[:-1], [tuple(p) for p in r["places"]]) for r in df.collect()), key=repr)


def expected(df):
    return sorted(((r["doc_id"], *expected_row(r["text"])) for r in df.select("doc_id", "text").collect()), key=repr)


def test_given_table(spark):
    found = got(op12_licenses(spark, SMALL))
    assert found == expected(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert sum(r[2] for r in found) > 30


def test_hard_rows(spark):
    df = hard_frame(spark)
    assert got(license_scans(df)) == expected(df)
    clashing = df
    for name in ("n_words", "labels", "text_", "places", "word", "n"):
        clashing = clashing.selectExpr("*", f"'clash' AS {name}")
    assert got(license_scans(clashing)) == expected(df)
    assert license_scans(empty_frame(spark)).collect() == []


def notice(t, r, keep):
    """A template with some of its other words replaced, cut or in capitals."""
    out = [w if is_key or r.random() < keep else r.choice(["x", "foo", "license", "the"]) for w, is_key in zip(t.words, t.key)]
    return r.choice([" ", "\n * ", ", "]).join(w.upper() if r.random() < 0.2 else w for w in out)


def test_planted_notices(spark):
    r = random.Random(4)
    filler = ["the", "license", "of", "gnu", "mit", "cc", "by", "general", "public", "apache", "word", "é", "2", "0", "under"]
    texts = []
    for i in range(300):
        parts = [" ".join(r.choice(filler) for _ in range(r.randint(0, 12)))]
        for _ in range(r.randint(0, 3)):
            parts += [notice(r.choice(TEMPLATES), r, r.choice([0.2, 0.6, 1.0])), " ".join(r.choice(filler) for _ in range(r.randint(0, 6)))]
        texts.append(" ".join(parts))
    # Cut at the borders of a text, across two texts, repeated, and very long.
    texts += ["public license", "gnu general", "public license version 3 gnu general public license", "cc by cc by cc by", "mit license " * 20_000]
    texts += [" ".join(t.words) for t in TEMPLATES] + [" ".join(t.words[t.key.index(True) :]) for t in TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = got(license_scans(df))
    assert found == expected(df)
    assert len({label for row in found for label in row[6].split(",")}) >= len({t.label for t in TEMPLATES})


def test_index_takes_the_rarest_key_words(spark):
    texts = ["license"] * 9 + ["apache"] * 2 + ["mit mit"] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    total, frequency = document_frequencies(df, ["apache", "license", "mit"], "text")
    assert (total, frequency) == (13, {"apache": 2, "license": 9, "mit": 1})
    index = positional_index(TEMPLATES[1:2], frequency)
    assert index.postings == (((0, 0),),) and index.other == (1,)
    assert positional_index(TEMPLATES[1:2], {"apache": 5}).postings == (((0, 1),),)
