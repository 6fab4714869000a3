from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

# Readings of river gauges: two repeated rows, missing cells, three extreme levels, dates in other forms.
SAMPLE_CSV = """gauge,keeper,read_date,level_cm,river,frozen
G-07,Ines,2021-02-01,212,Alder,false
G-08,Marek,2021-02-01,198,Birch,false
G-09,Ines,01.02.2021,205,Alder,false
G-10,,2021-02-02,190,Cedar,true
G-11,Tove,2021-02-02,9999,Birch,false
G-08,Marek,2021-02-01,198,Birch,false
G-12,Tove,soon,201,Alder,
G-13,Ines,2021-02-03,,Cedar,true
G-14,Marek,2021-02-03,208,Birch,false
G-15,,2021-02-04,-500,Alder,false
G-16,Tove,2021-02-04,196,Cedar,true
G-17,Ines,2021-02-05,203,alder,false
G-18,Marek,5 Feb,4100,Birch,
G-19,Tove,2021-02-06,210,Alder,false
G-16,Tove,2021-02-04,196,Cedar,true
G-20,Ines,2021-02-06,199,Cedar,true
"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tablewarden-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample(spark, tmp_path_factory) -> DataFrame:
    """Sixteen gauge readings with missing, repeated, extreme and unreadable values; rows keep their order."""
    from tablewarden import read_csv

    path = tmp_path_factory.mktemp("sample") / "sample.csv"
    path.write_text("".join(f"{head},{line}\n" for head, line in _numbered(SAMPLE_CSV)))
    return read_csv(spark, str(path))


def _numbered(text: str):
    lines = text.splitlines()
    yield "rid", lines[0]
    yield from ((str(i), line) for i, line in enumerate(lines[1:]))


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def by_column(df: DataFrame) -> dict:
    return {r["column"]: r for r in df.collect()}
