"""Every column type goes through the audit and the repair."""

import pytest

import tablewarden as tw
from tests.conftest import by_column, rows

COLUMNS = {
    "tiny": "CAST(id % 5 AS TINYINT)",
    "small": "CAST(id % 5 AS SMALLINT)",
    "whole": "CAST(id AS INT)",
    "big": "id * 10000000000",
    "single": "CAST(id / 4 AS FLOAT)",
    "real": "id / 3",
    "dec": "CAST(id / 8 AS DECIMAL(12,3))",
    "flag": "id % 2 = 0",
    "word": "concat('w', id % 3)",
    "day": "date_add(DATE'2024-01-01', CAST(id % 4 AS INT))",
    "instant": "timestamp_seconds(id % 6)",
    "local": "CAST(timestamp_seconds(id % 6) AS TIMESTAMP_NTZ)",
    "span": "make_dt_interval(CAST(id % 3 AS INT))",
    "months": "make_ym_interval(CAST(id % 3 AS INT))",
    "bytes": "CAST(concat('b', id % 2) AS BINARY)",
    "list": "array(id % 2, 1)",
    "record": "named_struct('a', id % 3, 'b', 'x')",
    "mapping": "map('k', id % 2)",
    "nothing": "NULL",
}
DISTINCT = {
    "tiny": 5, "small": 5, "whole": 36, "big": 36, "single": 36, "real": 36, "dec": 36, "flag": 2, "word": 3, "day": 4,
    "instant": 6, "local": 6, "span": 3, "months": 3, "bytes": 2, "list": 2, "record": 3, "mapping": None, "nothing": 0,
}


@pytest.fixture(scope="module")
def table(spark):
    """Forty rows: every tenth value is missing."""
    missing = [f"CASE WHEN id % 10 != 9 THEN {value} END AS {name}" for name, value in COLUMNS.items()]
    return spark.range(0, 40, 1, 3).selectExpr("id AS rid", *missing)


def test_audit(table):
    report = tw.audit(table, "rid")
    found = by_column(report.profile)
    assert {c: r["unique_count"] for c, r in found.items()} == DISTINCT
    assert all(r["missing_count"] == (40 if c == "nothing" else 4) for c, r in found.items())
    classes = {c: r["type_class"] for c, r in found.items()}
    assert classes["dec"] == "numeric" and classes["flag"] == "boolean" and classes["nothing"] == "string"
    assert {c for c, k in classes.items() if k == "temporal"} == {"day", "instant", "local", "span", "months"}
    assert {c for c, k in classes.items() if k == "other"} == {"bytes", "list", "record", "mapping"}
    assert (found["day"]["min_text"], found["day"]["max_text"]) == ("2024-01-01", "2024-01-04")
    assert tuple(found["local"]["top_values"][0]) == ("1970-01-01 00:00:00", 7)
    assert found["local"]["max_text"] == found["instant"]["max_text"] == "1970-01-01 00:00:05"
    assert (found["dec"]["min_number"], found["dec"]["max_number"]) == (0.0, 4.75)
    assert all(found[c]["top_values"] == [] and found[c]["min_text"] is None for c in ("bytes", "list", "record", "mapping"))
    assert report.score.first()["score"] > 0


def test_duplicates(table):
    assert tw.duplicate_count(table, "rid").first()[0] == 3
    assert sorted(rows(tw.duplicate_rows(table, "rid"))) == [(19,), (29,), (39,)]
    for name in COLUMNS:
        kept = tw.drop_duplicates(table, "rid", [name]).count()
        assert kept == tw.duplicate_flags(table, "rid", [name]).where("is_duplicate = 'Normal Record'").count(), name
        if DISTINCT[name] is not None:
            assert kept == max(1, DISTINCT[name] + (name != "nothing")), name


def test_repair(table):
    fixed = tw.repair(table, "rid")
    types = dict(fixed.cleaned.dtypes)
    assert (types["tiny"], types["single"], types["dec"], types["flag"]) == ("tinyint", "float", "decimal(12,3)", "boolean")
    assert types["day"] == "date" and types["mapping"] == "map<string,bigint>"
    log = by_column(fixed.change_log)
    filled = {c for c, r in log.items() if r["filled"]}
    assert filled == {"tiny", "small", "whole", "big", "single", "real", "dec", "flag", "word", "nothing"}
    assert {r["rows_dropped"] for r in log.values()} == {3}
    assert fixed.cleaned.count() == 37
