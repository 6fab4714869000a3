"""CSV records and types against Python's csv module, with byte ranges of a few hundred bytes."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

import tablewarden as tw
from tablewarden.errors import AuditError
from tablewarden.sources.csv_records import borders, scanned

from .conftest import DATA, rows


@pytest.fixture
def small_ranges(spark):
    """Files are dealt in ranges of 300 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(path, header, data, ending="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=ending, quoting=quoting)
        out.writerow(header)
        out.writerows(data)
    return str(path)


def odd_text(r):
    pieces = ["a", "bc", "é", "日本", "\n", "\n\n", '"', '""', ",", " ", "\r\n", '"\n', '\n"', ',"', '",', "'", "\\", "long " * r.randint(0, 40)]
    return "x" + "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_any_texts_across_ranges(spark, tmp_path, small_ranges, seed, ending):
    r = random.Random(seed)
    data = [(i, odd_text(r), odd_text(r)) for i in range(120)]
    quoting = csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL
    for part in range(3):
        written(tmp_path / f"{part}.csv", ["id", "one", "two"], data[part::3], ending, quoting)
    back = tw.read_csv(spark, str(tmp_path))
    assert back.dtypes == [("id", "int"), ("one", "string"), ("two", "string")]
    assert sorted(rows(back)) == data
    assert back.rdd.getNumPartitions() > 3
    assert back.count() == len(data) and sorted(rows(back.select("two"))) == sorted((d[2],) for d in data)


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f'line {i} of "many", with commas' for i in range(400))
    data = [(1, "short"), (2, long), (3, "b\nc"), (4, long + "\n"), (5, "end")]
    path = written(tmp_path / "t.csv", ["id", "text"], data)
    back = tw.read_csv(spark, path, schema="id int, text string")
    assert sorted(rows(back)) == data
    known = borders(scanned(spark, [path], 0))
    assert known.ranges > 10 and len(known.inside) == 1


def test_header_over_ranges_and_lines(spark, tmp_path, small_ranges):
    names = ["id", "the\n" * 200 + "text", "é"]
    path = written(tmp_path / "t.csv", names, [(1, "a\nb", "c")])
    back = tw.read_csv(spark, path, schema="id int, b string, c string")
    assert rows(back) == [(1, "a\nb", "c")]
    for part in ("a", "b"):
        written(tmp_path / f"{part}.txt", ["id", "two\nlines"], [(part, "x\ny")])
    back = tw.read_csv(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert back.columns == ["id", "two\nlines"] and sorted(rows(back)) == [("a", "x\ny"), ("b", "x\ny")]


def test_quotes_that_open_no_field(spark, tmp_path, small_ranges):
    lines = ["id,size,note", '1,5" pipe,plain', '2,3"x4",plain', '3,"a\n""b""",plain', '4,6",7"', '5,"",""']
    (tmp_path / "t.csv").write_text("\n".join(lines * 1) + "\n")
    want = [(1, '5" pipe', "plain"), (2, '3"x4"', "plain"), (3, 'a\n"b"', "plain"), (4, '6"', '7"'), (5, "", "")]
    assert sorted(rows(tw.read_csv(spark, str(tmp_path / "t.csv")))) == want


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,text\n")
    (tmp_path / "bom.csv").write_bytes('﻿"id",text\n1,"a\nb"\n\n   \n2,'.encode())
    assert sorted(rows(tw.read_csv(spark, str(tmp_path)))) == [(1, "a\nb"), (2, None)]
    assert tw.read_csv(spark, str(tmp_path / "head.csv")).dtypes == [("id", "string"), ("text", "string")]
    assert rows(tw.read_csv(spark, str(tmp_path / "empty.csv"))) == []
    (tmp_path / "open.csv").write_text('id,text\n1,"never closed\n2,x\n')
    with pytest.raises(AuditError, match="open.csv is never closed"):
        tw.read_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "other.csv").write_text("text,id\nx,1\n")
    with pytest.raises(AuditError, match="different headers"):
        tw.read_csv(spark, [str(tmp_path / "head.csv"), str(tmp_path / "other.csv")])


def test_odd_names(spark, tmp_path):
    path = written(tmp_path / "t.csv", ["a.b", "", "x`y", "A", "a", "_malformed", "_malformed_why"], [(1, 2, 3, 4, 5, 6, "q\nr")])
    back = tw.read_csv(spark, path)
    assert back.columns == ["a.b", "_c1", "x`y", "A3", "a4", "_malformed", "_malformed_why"]
    assert rows(back) == [(1, 2, 3, 4, 5, 6, "q\nr")]


@pytest.mark.parametrize("breaks", [False, True])
def test_misfits_are_named(spark, tmp_path, breaks):
    text = "two\nlines" if breaks else "one"
    path = written(tmp_path / "t.csv", ["id", "note", "price"], [(i, text, i / 4) for i in range(50)] + [(50, text, "12 Euro")])
    assert tw.read_csv(spark, path).dtypes[2] == ("price", "string")
    early = tw.read_csv(spark, path, sample_rows=50)
    assert early.dtypes == [("id", "int"), ("note", "string"), ("price", "double")]
    with pytest.raises(PySparkException, match="column price is double, the value is 12 Euro"):
        early.collect()
    for row in ((51, text), (51, text, 1, 2)):
        path = written(tmp_path / "u.csv", ["id", "note", "price"], [(1, text, 2), row])
        with pytest.raises(PySparkException, match="malformed record, it has not 3 fields"):
            tw.read_csv(spark, path).collect()


def test_types_of_values(spark, tmp_path):
    columns = {
        "int": ["1", "-2", "007", ""],
        "bigint": ["1", "9007199254740993", "", "2"],
        "decimal(20,0)": ["1", "12345678901234567890", "", "-3"],
        "double": ["1", "2.5", "1e300", "NaN"],
        "date": ["2024-02-29", "", "1999-12-31", "2024-01-01"],
        "timestamp": ["2024-02-29", "2024-01-01 10:11:12", "", ""],
        "boolean": ["true", "FALSE", "", "true"],
        "string": ["2024", "2024-01-01", "true", "1"],
        "string ": ["", "", "", ""],
        "string  ": ["true", "1", "", ""],
    }
    path = written(tmp_path / "t.csv", list(columns), list(zip(*columns.values(), strict=True)))
    back = tw.read_csv(spark, path)
    assert [kind for _, kind in back.dtypes] == [name.strip() for name in columns]
    assert back.count() == 4 and back.collect()[2][2] is None


@pytest.mark.parametrize("table", ["documents", "conversations", "orders", "customer", "part", "events", "benchmark", "pages"])
def test_given_tables_round_trip(spark, tmp_path, table):
    df = spark.read.parquet(f"{DATA}/{table}.parquet")
    tw.write_csv(df, str(tmp_path / "out"))
    back = tw.read_csv(spark, str(tmp_path / "out"))
    assert back.exceptAll(back.limit(0)).count() == df.count()
    # A full read tells the types of columns without line breaks; those with them are texts.
    full = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True, multiLine=True, quote='"', escape='"')
    assert back.dtypes == full.dtypes
    same = back.select(*[back[n].cast(t).alias(n) for n, t in df.dtypes])
    assert same.exceptAll(df).isEmpty() and df.exceptAll(same).isEmpty()


def test_files_without_line_breaks_stay_with_the_reader(spark, tmp_path):
    path = written(tmp_path / "t.csv", ["id", "a", "b"], [(i, "x, y", 'say "z"') for i in range(50)])
    plan = tw.read_csv(spark, path).select("b")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "a#" not in plan.split("ReadSchema")[-1]
    trusted = tw.read_csv(spark, path, schema="id int, a string, b string", line_breaks=False)
    assert sorted(rows(trusted)) == [(i, "x, y", 'say "z"') for i in range(50)]


def test_python_reads_the_same(spark, tmp_path):
    r = random.Random(11)
    text = "id,a\n" + "".join(f'{i},"{odd_text(r).replace(chr(34), chr(34) * 2)}"\n' for i in range(300))
    (tmp_path / "t.csv").write_bytes(text.encode())
    want = [(int(a), b) for a, b in list(csv.reader(io.StringIO(text, newline="")))[1:]]
    assert sorted(rows(tw.read_csv(spark, str(tmp_path / "t.csv")))) == want
