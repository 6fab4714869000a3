"""Row ids from places in files, and mergeable estimates of distinct counts."""

import os

import pytest
from pyspark.sql import functions as F

import tablewarden as tw
from tablewarden.errors import AuditError

from .conftest import DATA, rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def several_files(spark, tmp_path_factory):
    """5,000 rows in seven files of several row groups; k is the row's number in file order."""
    path = str(tmp_path_factory.mktemp("files") / "t")
    df = spark.range(0, 5000, 1, 7).selectExpr("id AS k", "repeat(uuid(), 20) AS t", "id % 3 AS _metadata")
    df.write.option("parquet.block.size", 65536).parquet(path)
    return path


@pytest.mark.parametrize("broadcast_files", [100_000, 3])
def test_ids_count_through_the_files(spark, several_files, broadcast_files):
    df, name = tw.read_parquet_with_row_id(spark, several_files, broadcast_files)
    assert df.columns == ["k", "t", "_metadata", name]
    assert df.count() == 5000 and df.where(F.col(name) != F.col("k")).count() == 0


def test_ids_do_not_depend_on_splits_filters_or_columns(spark, several_files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df, name = tw.read_parquet_with_row_id(spark, several_files)
        assert df.rdd.getNumPartitions() > 7
        assert df.where("k % 100 = 7").repartition(3).where(F.col(name) != F.col("k")).count() == 0
        assert rows(df.where("k >= 4998").select(name).orderBy(name)) == [(4998,), (4999,)]
        # The scan reads what is asked, and two uses of the ids agree without a copy.
        assert "ReadSchema: struct<k:bigint" in plan(df.select("k", name)) and "t:string" not in plan(df.select("k", name))
        assert df.select(name, "k").join(df.select(name, F.col("k").alias("again")), name).where("k != again").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_is_written(spark, several_files):
    root = spark.conf.get("spark.checkpoint.dir")
    before = sorted(os.listdir(root))
    df, name = tw.read_parquet_with_row_id(spark, several_files)
    assert tw.duplicate_rows(df.select("k", name), name).count() == 0
    assert sorted(os.listdir(root)) == before


def test_empty_parquet(spark, tmp_path):
    spark.range(0).selectExpr("id AS k").write.parquet(str(tmp_path / "e"))
    df, name = tw.read_parquet_with_row_id(spark, str(tmp_path / "e"))
    assert df.columns == ["k", name] and df.count() == 0


@pytest.mark.parametrize("precision", [8, 12, 16])
def test_estimates_lie_within_their_error(spark, precision):
    for table in ("lineitem", "documents", "events", "embeddings"):
        df = spark.read.parquet(f"{DATA}/{table}.parquet")
        exact = {r["column"]: r["unique_count"] for r in tw.distinct_counts(df).collect()}
        for r in tw.distinct_estimates(tw.distinct_sketches(df, precision=precision)).collect():
            if exact[r["column"]] is not None:
                assert abs(r["unique_estimate"] - exact[r["column"]]) <= 1 + 4 * r["standard_error"] * exact[r["column"]], r


def test_merged_parts_are_the_whole(spark):
    df = spark.range(0, 40_000, 1, 8).selectExpr("id", "id % 777 AS few", "CASE WHEN id < 20000 THEN NULL ELSE id END AS half")
    parts = [tw.distinct_sketches(df.where(f"id % 3 = {i}")) for i in range(3)]
    whole, merged = (tw.distinct_estimates(s).orderBy("position").collect() for s in (tw.distinct_sketches(df), tw.merged_sketches(*parts)))
    assert [r["column"] for r in merged] == [r["column"] for r in whole] == ["id", "few", "half"]
    for r, exact in zip(merged, (40_000, 777, 20_000), strict=True):
        assert abs(r["unique_estimate"] - exact) <= 1 + 4 * r["standard_error"] * exact
    # Merging with a coarser sketch states the coarser error.
    coarse = tw.distinct_estimates(tw.merged_sketches(parts[0], tw.distinct_sketches(df, precision=8)))
    assert coarse.first()["standard_error"] == pytest.approx(1.04 / 16)


def test_stored_sketches(spark, tmp_path):
    tw.distinct_sketches(spark.range(1000).selectExpr("id", "id % 5 AS five"), "id").write.parquet(str(tmp_path / "s"))
    assert rows(tw.distinct_estimates(spark.read.parquet(str(tmp_path / "s"))).select("column", "unique_estimate")) == [("five", 5)]


def test_nulls_nested_values_and_empty_tables(spark):
    df = spark.createDataFrame(
        [(None, [], float("nan"), {"a": 1}), (None, [None], -0.0, {}), (None, None, 0.0, None), (None, [], 1.0, {"a": 1})],
        "n int, l array<int>, d double, m map<string, int>",
    )
    found = {r["column"]: r["unique_estimate"] for r in tw.distinct_estimates(tw.distinct_sketches(df)).collect()}
    assert found == {"n": 0, "l": 2, "d": 2, "m": 2}
    assert {r["unique_estimate"] for r in tw.distinct_estimates(tw.distinct_sketches(df.limit(0))).collect()} == {0}
    assert tw.distinct_sketches(spark.range(3), "id").count() == 0
    with pytest.raises(AuditError):
        tw.distinct_sketches(df, precision=3)


def test_sketches_shuffle_no_values(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    found = plan(tw.distinct_sketches(df))
    assert "hashpartitioning" not in found and found.count("FileScan") == 1
