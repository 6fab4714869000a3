"""Text rules against DuckDB and Python, and CSV files."""

import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablewarden import read_csv, read_parquet, write_csv
from tablewarden.functions.numbers import two_decimal_text, two_decimals
from tablewarden.functions.patterns import is_email, reads_as_date, reads_as_number
from tests.conftest import rows

NUMBERS = [
    "1", "-1", "+1", "1.", ".5", "-.5", "1.5e3", "1E-2", "1e", "e5", ".", "", " ", " 12 ", "\t12\n", "1_000", "1__0",
    "_1", "1_", "1d", "1f", "0x10", "inf", "-Infinity", "nan", "NaN", "infinit", "1,000", "12 3", "--1", "$5", "abc",
    "N", "i", "1.2.3", "+-1", "-+1", "++1", "+-inf", " +-.5e-3 ", "+-", "+- 1", "1e5.5", "00012", "9" * 400, "1" * 20000, "1_1" * 3000, "Ⅷ", "١٢",
]
DATES = [
    "2023-01-15", "2023/06/12", "15/02/2023", "NOT_A_DATE", "2023-1-5", "2023 1 5", "2023\\1\\5", "2023-02-29",
    "2024-02-29", "2023-13-01", "2023-00-10", "2023-01-32", "2023-01/15", "20230115", "2023-01", "2023", "10:00:00",
    "2023-01-15 10:20", "2023-01-15 10:20:30", "2023-01-15T10:20:30.123", "2023-01-15 10:20:30Z",
    "2023-01-15 10:20:30+02", "2023-01-15 10:20:30 UTC", "2023-01-15 25:00:00", "2023-01-15 abc", " 2023-01-15 ",
    "epoch", "infinity", "-infinity", "EPOCH", "44-03-15", "2024-02-29 (BC)", "2025-02-29 (BC)", "2024-01-01(BC)",
    "2024-01-01 (bc)", "0000-01-01 (BC)", "-2024-01-01 (BC)", "2101-02-29 (BC)", "2001-02-29 (bC)", "-0004-02-29", "0044-03-15", "12345-01-01", "", "x", "1-1-1",
]


@pytest.mark.parametrize(
    ("texts", "rule", "sql"),
    [
        (NUMBERS, reads_as_number, "TRY_CAST(t AS DOUBLE) IS NOT NULL"),
        (DATES, reads_as_date, "TRY_CAST(t AS DATE) IS NOT NULL OR TRY_CAST(t AS TIMESTAMP) IS NOT NULL"),
    ],
)
def test_readable_texts(spark, texts, rule, sql):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = dict(rows(df.select("i", F.expr(rule("t")))))
    want = [duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS t)", [t]).fetchone()[0] for t in texts]
    assert [t for i, t in enumerate(texts) if got[i] != want[i]] == []


def enumerated(parts, most):
    return ["".join(x) for n in range(1, most + 1) for x in itertools.product(parts, repeat=n)]


@pytest.mark.parametrize(
    ("texts", "rule", "sql"),
    [
        (enumerated("+-.1e _", 6) + enumerated(["+", "-", " ", "inf", "infinity", "nan", "1", "\t"], 4), reads_as_number, "TRY_CAST(t AS DOUBLE) IS NOT NULL"),
        (
            [
                f"2023-01-05{begin}{end}"
                for begin in ("", " 10:00:00", " 24", " 24:00", " 10:00", " 10:00:00.1", " 10:00:00+10", " 10:00:00+10:00", "T10:0", "  ", " (BC)")
                for end in ["", *enumerated([" ", "T", "10", "1", "24", "00", "0", ":", ".", "Z", "+", "-", " (BC)", "UTC"], 3)]
            ],
            reads_as_date,
            "TRY_CAST(t AS DATE) IS NOT NULL OR TRY_CAST(t AS TIMESTAMP) IS NOT NULL",
        ),
    ],
    ids=["numbers", "dates"],
)
def test_every_text_of_a_small_alphabet(spark, texts, rule, sql):
    listed = pa.table({"t": texts})
    want = duckdb.execute(f"SELECT {sql} AS r FROM listed").fetchnumpy()["r"]
    got = spark.createDataFrame(listed).select("t", F.expr(rule("t"))).collect()
    judged = dict(zip(texts, want, strict=True))
    assert [t for t, r in got if bool(r) != bool(judged[t])] == []
    assert 100 < sum(map(bool, judged.values())) < len(judged)


def test_addresses(spark):
    good = ["a@b.co", "first.last+tag@sub.example.org", "A_%-1@x-y.museum"]
    bad = ["bad@", "a@b", "a b@c.de", "@b.co", "a@b.c", "a@b.co\n", "ä@b.co", "a@b.co ", "a@@b.co", ""]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in rows(df.select(F.expr(is_email("t"))))] == [True] * len(good) + [False] * len(bad)


def test_missing_texts_are_neither(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert tuple(df.selectExpr(reads_as_number("t"), reads_as_date("t"), is_email("t")).first()) == (None, None, None)


def test_two_decimals_print_like_c(spark):
    rng = random.Random(5)
    values = [0.125, 0.375, 2.675, 1.005, 1.115, 0.145, 8.325, 0.0, 100.0, 99.995, 99.994999, 0.005, 0.015, 1 / 3, 12.5]
    values += [rng.randrange(0, 100_000) / 1000 for _ in range(3000)]
    values += [m / n * 100 for n in range(1, 120) for m in range(n + 1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.selectExpr(two_decimal_text("v"), two_decimals("v")).collect()
    assert [g[0] for g in got] == [f"{v:.2f}" for v in values]
    assert [g[1] for g in got] == [round(v * 100.0) / 100.0 for v in values]


def test_csv_keeps_odd_texts(spark, tmp_path):
    data = [(1, 'say "hi", ok', 1.5), (2, "", None), (3, None, -0.1), (4, "back\\slash", 1e300), (5, "é,ü", 2.0)]
    df = spark.createDataFrame(data, "i int, t string, d double")
    write_csv(df, str(tmp_path / "out"), single_file=True)
    back = read_csv(spark, str(tmp_path / "out"))
    assert back.dtypes == df.dtypes
    assert sorted(rows(back)) == data
    with pytest.raises(AnalysisException):
        write_csv(df, str(tmp_path / "out"))


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,one\n')
    assert rows(read_csv(spark, str(path))) == [(1, "two\nlines"), (2, "one")]


def test_values_that_do_not_fit_a_given_type_fail(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a\n1\nx\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(path), schema="a int").collect()


def test_missing_files_name_their_path(spark, tmp_path):
    for read in (read_csv, read_parquet):
        with pytest.raises(AnalysisException, match="no_such_table"):
            read(spark, str(tmp_path / "no_such_table"))
