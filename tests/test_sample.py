"""The sixteen gauge readings, audited and repaired end to end."""

import statistics

import pytest

from tablewarden import (
    Settings,
    anomalies,
    audit,
    change_log,
    duplicate_count,
    duplicate_rows,
    medians,
    outlier_rows,
    repair,
)
from tests.conftest import by_column, rows


@pytest.fixture(scope="module")
def audited(sample):
    return audit(sample, row_id="rid")


def test_inferred_types(sample):
    assert [t for _, t in sample.dtypes] == ["int", "string", "string", "string", "int", "string", "boolean"]


def test_profile(audited):
    found = by_column(audited.profile)
    expected = {
        "gauge": (0, 14, 0, 0),
        "keeper": (2, 3, 0, 0),
        "read_date": (0, 9, 0, 3),
        "level_cm": (1, 13, 3, 0),
        "river": (0, 4, 0, 0),
        "frozen": (2, 2, 0, 0),
    }
    for name, figures in expected.items():
        r = found[name]
        assert (r["missing_count"], r["unique_count"], r["outlier_count"], r["mismatch_count"]) == figures, name
    levels = [212, 198, 205, 190, 9999, 198, 201, 208, -500, 196, 203, 4100, 210, 196, 199]
    level = found["level_cm"]
    # The quartiles are 198 and 210: positions 4 and 11 of fifteen, counted from 0.
    assert sorted(levels)[4] == 198 and sorted(levels)[11] == 210
    assert (level["lower_fence"], level["upper_fence"]) == (198 - 18.0, 210 + 18.0)
    assert (level["min_number"], level["max_number"]) == (-500.0, 9999.0)
    assert level["mean_value"] == pytest.approx(statistics.mean(levels))
    assert level["std_value"] == pytest.approx(statistics.stdev(levels))
    assert level["dataset_duplicate_count"] == 2
    assert [tuple(v) for v in level["top_values"]] == [("196", 2), ("198", 2), ("-500", 1), ("190", 1), ("199", 1)]
    assert found["frozen"]["top_values"][0]["value"] == "false"
    assert (found["river"]["min_text"], found["river"]["max_text"]) == ("Alder", "alder")


def test_scores(audited):
    assert rows(audited.scores.select("column", "score")) == [
        ("gauge", 95),
        ("keeper", 91),
        ("read_date", 86),
        ("level_cm", 83),
        ("river", 98),
        ("frozen", 91),
    ]
    score = audited.score.first()
    assert (score["mean_score"], score["score"], score["grade"]) == (pytest.approx(544 / 6), 84, "Good")


def test_issues(audited):
    found = rows(audited.issues.select("rank", "column", "metric", "severity", "score_impact"))
    assert found == [
        (1, "Dataset", "Duplicates", "High", 6.25),
        (2, "keeper", "Completeness", "High", 6.25),
        (3, "frozen", "Completeness", "High", 6.25),
        (4, "read_date", "Type Consistency", "High", 4.69),
        (5, "level_cm", "Outlier Rate", "High", 3.75),
        (6, "level_cm", "Completeness", "Medium", 2.5),
    ]
    texts = [r["description"] for r in audited.issues.collect()]
    assert texts[0] == "Dataset contains 2 duplicate rows (12.50% of total)."
    assert texts[1] == "Column contains 12.50% missing values."
    assert texts[3] == "Detected 3 structural type anomalies in column values."
    assert texts[4] == "Detected 3 statistical anomalies outside IQR thresholds."


def test_summary_and_tables(audited):
    summary = audited.summary.first()
    assert (summary["overall_score"], summary["category"], len(summary["issues"])) == (84, "Good", 6)
    assert summary["issues"][0]["metric"] == "Duplicates"
    assert tuple(audited.overview.first()) == (84, "Good", 16, 6, 6, "Requires Fix")
    table = rows(audited.column_table.select("column", "score", "status"))
    assert table[0] == ("level_cm", 83, "🚨 Missing, 📊 Outliers")
    assert table[1] == ("read_date", 86, "⚠️ Mismatch")
    assert table[-1] == ("river", 98, "✅ Clean")
    bands = rows(audited.score_bands.select("column", "color_hex"))
    assert bands[0] == ("level_cm", "#3498DB") and bands[-1] == ("river", "#2ECC71")


def test_rows_with_findings(sample, audited):
    assert sorted(rows(duplicate_rows(sample, "rid"))) == [(5,), (14,)]
    assert sorted(rows(outlier_rows(sample, "rid").select("rid"))) == [(4,), (9,), (12,)]
    assert sorted(rows(audited.duplicate_rows())) == [(5,), (14,)]
    assert sorted(rows(audited.outlier_rows(["level_cm"]).select("rid"))) == [(4,), (9,), (12,)]


def test_anomalies(sample):
    assert rows(anomalies(sample, "rid").select("column", "kind", "affected_rows")) == [("read_date", "unreadable_date", 3)]


def test_suggestions(audited):
    found = rows(audited.suggestions.select("action_type", "column", "estimated_impact"))
    assert found == [
        ("DROP_DUPLICATES", "All Columns", "High"),
        ("FILL_MISSING", "keeper", "Medium"),
        ("FILL_MISSING", "level_cm", "Medium"),
        ("CAP_OUTLIERS", "level_cm", "Medium"),
        ("FILL_MISSING", "frozen", "Medium"),
    ]


@pytest.mark.parametrize("row_id", ["rid", None])
def test_repair(sample, row_id):
    table = sample if row_id else sample.drop("rid")
    fixed = repair(table, row_id)
    assert by_column(medians(sample, "rid"))["level_cm"]["median"] == 201.0
    # Without the repeated 198 and 196 the middle of thirteen is 203, a whole number: the column keeps its type.
    assert dict(fixed.cleaned.dtypes)["level_cm"] == "int"
    cleaned = {r["gauge"]: r for r in fixed.cleaned.collect()}
    assert len(cleaned) == 14
    assert cleaned["G-13"]["level_cm"] == 203
    assert [cleaned[g]["level_cm"] for g in ("G-11", "G-18", "G-15", "G-07")] == [228, 228, 180, 212]
    assert cleaned["G-10"]["keeper"] == cleaned["G-15"]["keeper"] == "Unknown"
    assert cleaned["G-12"]["frozen"] is False
    log = by_column(fixed.change_log)
    assert {n: r["mutations"] for n, r in log.items()} == {
        "gauge": 0,
        "keeper": 2,
        "read_date": 0,
        "level_cm": 4,
        "river": 0,
        "frozen": 2,
    }
    assert (log["level_cm"]["filled"], log["level_cm"]["modified"]) == (1, 3)
    assert {r["rows_dropped"] for r in log.values()} == {2}
    if row_id:
        joined = by_column(change_log(sample, fixed.cleaned, "rid"))
        assert joined == log
        assert sorted(r[0] for r in rows(fixed.cleaned.select("rid"))) == [i for i in range(16) if i not in (5, 14)]


def test_repair_by_subset(sample):
    settings = Settings(duplicate_subset=("keeper", "river"))
    fixed = repair(sample, "rid", settings)
    assert fixed.suggestions.first()["description"].startswith("Purge 7 ")
    assert {r["rows_dropped"] for r in fixed.change_log.collect()} == {7}
    kept = sample.join(fixed.cleaned.select("rid"), "rid")
    assert kept.count() == 9 and duplicate_count(kept, "rid", settings.subset).first()[0] == 0
