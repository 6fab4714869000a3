"""Accuracy on held-out documents, kernels against sets of n-grams, and rows that are hard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm.language_id import Fit, fitted, languages, training_rows
from tablewarden.llm.queries import op6_language_id

from .hard import empty_frame, hard_frame, on_disk

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op6_language_id(spark, SMALL).collect()
    assert len(rows) == len(docs)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 250
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in unseen]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def gram_set(text):
    raw = text.lower().encode()
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_kernel_counts_shared_grams():
    texts = ["the cat sat", "der Hund lief", "the dog ran", "die Katze sass", "the bird", "das Haus"]
    labels = ["en", "de"] * 3
    model = fitted(texts, labels, Fit(landmarks=2))
    model.prepare()
    landmarks = [texts[i] for i in (1, 3, 0, 2)]
    known = set().union(*map(gram_set, landmarks))
    for text in ["the cat", "Hund und Katze", "ÄÖ zz"]:
        own = gram_set(text) & known
        want = [len(own & gram_set(z)) / max(1, np.sqrt(len(own) * len(gram_set(z)))) for z in landmarks]
        assert (model.presence([text]) @ model.landmarks)[0] == pytest.approx(want, abs=1e-6)
    scores = model.scores(texts)
    assert [model.languages[k] for k in scores.argmax(axis=1)] == labels


def test_labels_do_not_matter_for_a_prediction(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6_language_id(spark, SMALL).collect()}
    # Labels and sources of held-out rows are gone; what was learned stays the same.
    blind = df.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1 THEN lang END AS lang", "'x' AS source", "n_chars")
    after = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6_language_id(spark, on_disk(blind, tmp_path)).collect()}
    assert before == after


def test_hard_rows(spark, tmp_path):
    rows = op6_language_id(spark, on_disk(hard_frame(spark), tmp_path)).collect()
    assert len(rows) == hard_frame(spark).count()
    texts = {r["doc_id"]: r["text"] for r in hard_frame(spark).collect()}
    for r in rows:
        if r["doc_id"] in (0, 1, 2):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0), texts[r["doc_id"]]
    assert {r["lang_pred"] for r in languages(hard_frame(spark, extra=True), None).collect()} == {"und"}
    assert op6_language_id(spark, on_disk(empty_frame(spark), tmp_path / "none")).count() == 0


def test_languages_with_long_texts_only_are_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang IS NOT NULL AND text != ''")
    one = docs.selectExpr("min(lang) AS lang").first()["lang"]
    long = docs.withColumn("text", F.expr(f"CASE WHEN lang = '{one}' THEN repeat(concat(text, ' '), 1 + cast(7000 / length(text) AS int)) ELSE text END"))
    texts, labels = training_rows(long, Fit())
    assert set(labels) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    assert max(map(len, texts)) == Fit.longest
    model = fitted(texts, labels)
    own = languages(long.where(F.col("lang") == one), model).collect()
    assert np.mean([r["lang_pred"] == one for r in own]) > 0.97


def test_windows_and_number_of_labels(spark):
    rows = [(i, "".join(chr(97 + (i + k) % 26) for k in range(i % 40)), f"l{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, labels = training_rows(df, Fit(longest=12))
    given = {lang: {t for _, t, own in rows if own == lang} for lang in ("l0", "l1", "l2")}
    for text, lang in zip(texts, labels, strict=True):
        assert 0 < len(text) <= 12 and any(text in whole and len(text) == min(12, len(whole)) for whole in given[lang])
    assert training_rows(df, Fit(longest=12)) == (texts, labels)
    with pytest.raises(ValueError, match="labels"):
        training_rows(df, Fit(most_languages=2))
    assert training_rows(df.limit(0), Fit()) == ([], [])


def test_clashing_columns(spark):
    df = hard_frame(spark, extra=True).withColumns({"lang_pred": F.lit("x"), "score": F.lit("y"), "place": F.lit("z")})
    rows = languages(df, fitted(["abc abc", "xyz xyz"], ["a", "b"])).collect()
    assert {r["place"] for r in rows} == {"z"} and {r["lang_pred"] for r in rows} <= {"a", "b", "und"}
    assert training_rows(df.withColumns({"rows": F.lit(1), "limit": F.lit(2)}), Fit())[0]
