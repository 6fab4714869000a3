"""Measures and line frequency against plain Python."""

import re
from collections import Counter, defaultdict

from tablewarden.llm.quality import Limits, quality_rules
from tablewarden.llm.queries import op3_quality

from .hard import empty_frame, hard_frame, on_disk, random_texts

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c for c in line)
    return " ".join(WORD.findall(low))


def measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def expected(docs, limits=Limits()):
    texts = defaultdict(set)
    for d in docs:
        texts[d["source"]].add(d["text"] or "")
    above = {}
    for host, held in texts.items():
        counts = Counter(x for t in held for x in {normal(line) for line in t.split("\n")} if x)
        above[host] = {x for x, n in counts.items() if n > limits.line_documents and n > limits.line_share * len(held)}
    out = []
    for d in docs:
        text = d["text"] or ""
        n, *rest = measures(text)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        removed = sum(len(WORD.findall(x)) for x in text.split("\n") if normal(x) in above[d["source"]])
        out.append((d["doc_id"], n, *rest, failed, not failed and n - removed >= limits.left_share * n, removed))
    return sorted(out, key=repr)


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted((tuple(r) for r in op3_quality(spark, str(folder)).collect()), key=repr)
    assert got == expected(docs)
    return got


def test_given_table(spark):
    check(spark, SMALL)


def test_hard_rows(spark, tmp_path):
    check(spark, on_disk(hard_frame(spark), tmp_path))


def test_frequent_lines_and_depleted_documents(spark, tmp_path):
    schema = hard_frame(spark).schema
    texts = random_texts(60, 5, words=120)
    rows = [(i, f"Shared  line {i % 7} of the host\n{t}", "en", "a" if i % 3 else None, 0) for i, t in enumerate(texts)]
    # Copies count once, so their lines stay.
    rows += [(100 + i, "copied text " + " ".join(f"w{k}" for k in range(70)), "en", "a", 0) for i in range(40)]
    rows += [(200, "shared line 3 of the host\n" * 30 + " ".join(f"u{k}" for k in range(60)), "en", "a", 0)]
    got = check(spark, on_disk(spark.createDataFrame(rows, schema), tmp_path))
    by_id = {r[0]: r for r in got}
    assert by_id[100][-2] and not by_id[200][-2] and by_id[1][-1] > 0


def test_clean_text(spark):
    rows = [(i, f"MENU line\nbody {i} one two", "h") for i in range(20)] + [(99, None, "h")]
    out = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r["clean_text"] for r in out} == {f"body {i} one two" for i in range(20)} | {""}


def test_empty_and_extra_columns(spark):
    assert quality_rules(empty_frame(spark)).count() == 0
    assert quality_rules(hard_frame(spark, extra=True).drop("body_", "words_")).count() == hard_frame(spark).count()


def test_lines_on_a_large_host(spark):
    # Fifteen of 400 documents: more than ten, less than a tenth.
    # Digits are all the same in lines.
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, ("Accept all cookies\n" if i < 15 else "") + f"body of {name(i)} {' '.join(f'{name(i)}x{name(k)}' for k in range(60))}", "hot") for i in range(400)]
    rows += [(1000 + i, "Accept all cookies\nbody of another host", "cold") for i in range(10)] + [(0, rows[0][1], "hot")] * 30
    out = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(out) == len(rows)
    for r in out:
        own = r["source"] == "hot" and r["doc_id"] < 15
        assert r["n_removed_words"] == (3 if own else 0)
        assert r["clean_text"] == (r["text"].split("\n")[-1] if own else r["text"])
