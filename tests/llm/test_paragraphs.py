"""Repeated passages against all windows of fifty words, compared directly."""

import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from tablewarden.llm.paragraphs import repeated_paragraphs
from tablewarden.llm.tables import staged
from tablewarden.sources.scratch import scratch_copies

from .hard import empty_frame, hard_frame

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def places(docs):
    """(doc, first character, end) of every window that two documents hold, by its words."""
    held = defaultdict(list)
    for key, text in docs:
        found = [(m.group().encode().lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]
        for i in range(len(found) - 49):
            held[tuple(w for w, _, _ in found[i : i + 50])].append((key, found[i][1], found[i + 49][2]))
    return {words: at for words, at in held.items() if len({key for key, _, _ in at}) > 1}


def check(spark, docs):
    rows = repeated_paragraphs(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    spans = defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["end"], r["removed"]))
    shared = places(docs)
    for at in shared.values():
        first = min(at, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))[0]
        for key, start, end in at:
            assert any(a <= start and end <= b for a, b, _ in spans[key])
            if key != first:
                assert any(a <= start and end <= b and gone for a, b, gone in spans[key])
    return rows, shared


def sentence(seed, count):
    r = random.Random(seed)
    return [f"{r.choice('aeé日')}{r.randint(0, 10**6)}" for _ in range(count)]


def test_passages_in_a_line_and_across_lines(spark):
    passage, other = sentence(1, 52), sentence(2, 50)
    inside = [" ".join(sentence(10 + i, 30 + i) + passage + sentence(20 + i, 100 + 150 * i)) for i in range(2)]
    broken = " ".join(sentence(30, 20)) + "\n" + "\n".join(" ".join(other[k : k + 10]) for k in range(0, 50, 10))
    whole = " ".join(sentence(31, 7) + [w.encode().upper().decode() for w in other] + sentence(32, 300))
    short = [" ".join(sentence(40 + i, 60) + passage[:49]) for i in range(2)]
    docs = [(1, inside[0]), (2, inside[1]), (3, broken), (4, whole), (5, "one two"), (6, None), (None, "x " * 200), (8, short[1])]
    rows, shared = check(spark, docs)
    assert len(shared) == 4
    assert {(r["doc_id"], r["line"], r["first_doc_id"], r["first_line"], r["removed"]) for r in rows} == {
        (1, 0, 1, 0, False), (2, 0, 1, 0, True), (3, 1, 3, 1, False), (4, 0, 3, 1, True),
    }
    texts = dict(docs)
    cut = {r["doc_id"]: texts[r["doc_id"]][r["start"] : r["end"]].lower().split() for r in rows}
    assert cut == {1: passage, 2: passage, 3: other, 4: other}


def test_repeats_inside_documents_and_null_ids(spark):
    loop = " ".join(sentence(3, 7) * 20)
    check(spark, [(1, loop), (2, "before " + loop), (None, "null " + loop), (3, " ".join(sentence(4, 60) * 3))])


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs)


def test_copies_repeated_rows_and_null_ids_get_their_spans(spark):
    passage = " ".join(sentence(50, 55))
    copied, other = f"{passage}\ntail one", " ".join(sentence(51, 30)) + " " + passage
    docs = [(i, copied) for i in range(40, 10, -1)] + [(11, copied)] * 3 + [(None, copied)] * 4 + [(5, other), (5, other), (60, other)]
    rows, shared = check(spark, docs)
    # 57 words of the copies, 85 of the other text: windows of fifty words.
    assert len(shared) == 8 + 36 - 6
    assert len(rows) >= len(docs)
    assert {r["doc_id"] for r in rows if not r["removed"]} == {None, 5}
    # The null document is the first with the passage; the whole line of document 60 is one of document 5.
    assert {r["first_doc_id"] for r in rows if r["doc_id"] == 5 and r["removed"]} == {None}
    assert {r["first_doc_id"] for r in rows if r["doc_id"] == 60} == {5}


def test_only_one_document_holds_it(spark):
    text = " ".join(sentence(52, 70))
    rows, shared = check(spark, [(1, text), (1, text), (1, "start " + text), (2, "x")])
    assert not rows and not shared
    rows, _ = check(spark, [(None, text), (None, text)])
    assert not rows


def test_near_equal_lines_are_found(spark):
    """Pairs of lines at similarity 0.75 or a little above, at least 0.9 of them; here all."""
    docs, pairs = [], 0
    for k in range(300):
        line = sentence(1000 + k, 80)
        near = list(line)
        near[40] = "other"
        # 76 shingles each, five differ: similarity 71 / 81; a second change gives 66 / 86 = 0.767.
        near[20] = "another"
        docs += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(near))]
        pairs += 1
    rows = repeated_paragraphs(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    found = {r["doc_id"] // 2 for r in rows if r["removed"] and r["first_doc_id"] == r["doc_id"] - 1}
    assert len(found) >= 0.9 * pairs
    assert len(found) == pairs


def test_hard_empty_and_clashing_rows(spark):
    names = ("class", "mark", "wanted", "hash", "word", "line", "end", "least", "most", "first", "span", "new", "of", "removed", "first_doc_id")
    long = " ".join(sentence(53, 60))
    df = hard_frame(spark, extra=True)
    more = spark.createDataFrame([(100, long), (101, long), (None, long)], SCHEMA)
    df = df.unionByName(more, allowMissingColumns=True)
    plain = sorted(map(tuple, repeated_paragraphs(df).collect()), key=repr)
    assert len(plain) == 3
    for name in names:
        df = df.selectExpr("*", f"'clash' AS {name}") if name not in df.columns else df
    assert sorted(map(tuple, repeated_paragraphs(df).collect()), key=repr) == plain
    assert repeated_paragraphs(empty_frame(spark)).count() == 0


def test_what_is_not_needed_any_more_is_deleted(spark):
    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before = shuffled()
    counted = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert counted.count() == 7

    copies = set(scratch_copies(spark))
    passage = " ".join(sentence(60, 60))
    rows = repeated_paragraphs(spark.createDataFrame([(1, passage), (2, "more " + passage), (3, "x")], SCHEMA))
    held = {re.sub(r"-[0-9a-f]{32}$", "", path.rsplit("/", 1)[1]) for path in set(scratch_copies(spark)) - copies}
    assert held == {"similar-paragraphs", "text-members", "first-ids", "numbered-classes", "spans"}
    assert {r["doc_id"] for r in rows.collect() if r["removed"]} == {2}


def test_first_line_of_an_id_with_two_texts(spark):
    passage = " ".join(sentence(61, 55))
    # Both texts of document 1 hold the passage; document 2 has it too, and a null id comes first.
    docs = [(1, "a\nb\n" + passage), (1, " ".join(sentence(62, 20)) + "\n" + passage), (2, " ".join(sentence(63, 9)) + " " + passage)]
    rows, _ = check(spark, docs)
    assert {(r["doc_id"], r["first_doc_id"]) for r in rows} == {(1, 1), (2, 1)}
    rows, _ = check(spark, [*docs, (None, "z " + passage)])
    assert {r["first_doc_id"] for r in rows if r["removed"]} == {None}
