"""Plans and results that must hold on large and skewed tables."""

import pytest
from pyspark.sql import functions as F

import tablewarden as tw
from tablewarden.functions.columns import audited_columns
from tablewarden.operators.frequency import value_summary
from tablewarden.operators.profile import column_facts
from tests.conftest import DATA, by_column, rows


def plan(df, mode="formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def final_plan(df) -> str:
    """The adaptive plan after the run."""
    df.collect()
    return plan(df, "simple")


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{DATA}/lineitem.parquet")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are copies of one row; one text fills another third of a column."""
    return spark.range(0, 30_000, 1, 12).selectExpr(
        "id AS rid",
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k",
        "CASE WHEN id % 3 = 0 THEN 1.5D WHEN id % 3 = 1 THEN CAST(id AS DOUBLE) END AS v",
        "CASE WHEN id % 3 = 2 THEN CAST(id AS STRING) ELSE repeat('hot text ', 50) END AS t",
    )


def test_scans_read_only_what_is_asked(lineitem):
    found = plan(tw.duplicate_count(lineitem, None, ["l_orderkey", "l_linenumber"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in found
    found = plan(tw.outlier_counts(lineitem, None, ["l_quantity"]))
    assert "ReadSchema: struct<l_quantity:double>" in found
    nulls = plan(tw.null_counts(lineitem.select("l_tax", "l_discount")))
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in nulls


def test_filters_reach_the_scan(lineitem):
    found = plan(tw.duplicate_count(lineitem.where("l_quantity > 10"), None, ["l_orderkey"]))
    assert "GreaterThan(l_quantity,10.0)" in found


def test_counts_are_combined_before_every_shuffle(lineitem):
    for df in (
        tw.duplicate_count(lineitem),
        tw.distinct_counts(lineitem),
        column_facts(lineitem, audited_columns(lineitem)),
    ):
        found = plan(df, "simple")
        for part in found.split("Exchange ")[1:]:
            below = part.split("\n")[1]
            assert "Aggregate" in below, below


def test_no_pairs_and_no_global_row_windows(lineitem):
    orders = lineitem.withColumn("rid", F.monotonically_increasing_id())
    for df in (
        tw.duplicate_rows(orders, "rid"),
        tw.duplicate_flags(orders, "rid", ["l_orderkey"]),
        tw.drop_duplicates(orders, "rid", ["l_partkey"]),
        tw.top_values(lineitem),
        tw.distinct_counts(lineitem),
        tw.missing_blocks(orders, "rid"),
        tw.change_log(orders, orders, "rid"),
        tw.histogram(lineitem),
        tw.outlier_rows(orders, "rid"),
    ):
        found = plan(df, "simple")
        assert "CartesianProduct" not in found and "NestedLoopJoin" not in found
        for line in found.splitlines():
            # Windows only rank grouped values, after a limit per task.
            assert " Window " not in line or "position" in line


def test_outlier_rows_need_no_shuffle(lineitem):
    df = lineitem.withColumn("rid", F.monotonically_increasing_id())
    assert "Exchange" not in plan(tw.outlier_rows(df, "rid"), "simple")
    assert "Exchange" not in plan(tw.missing_matrix(df, "rid"), "simple")


def test_distinct_counts_and_top_values_share_a_shuffle(lineitem):
    found = final_plan(value_summary(lineitem))
    assert found.split("Initial Plan")[0].count("ReusedExchange") >= 4


def test_short_texts_are_not_fetched_again(lineitem):
    found = final_plan(tw.top_values(lineitem.select("l_returnflag", "l_linestatus"))).split("Initial Plan")[0]
    assert found.count("FileScan") == 1


def test_aggregates_of_numbers_are_compiled(spark, lineitem):
    """Texts are kept apart: their minimum would turn the aggregate of all columns into an interpreted one."""
    columns = [c for c in audited_columns(lineitem) if c.type_class != "string"]
    text = final_plan(column_facts(lineitem, columns)).split("Initial Plan")[0]
    lines = [line for line in text.splitlines() if "Aggregate" in line]
    assert len(lines) == 2 and all("*(" in line and "HashAggregate" in line for line in lines)


def test_skewed_table(skewed):
    hot = 10_000
    found = by_column(tw.profile(skewed, "rid"))
    assert [found[c]["unique_count"] for c in ("k", "v", "t")] == [19_999 + 1, 10_001, 10_001]
    assert tuple(found["k"]["top_values"][0]) == ("7", hot + (1 if 7 % 3 else 0))
    assert tuple(found["t"]["top_values"][0]) == ("hot text " * 50, 2 * hot)
    assert tw.duplicate_count(skewed, "rid").first()[0] == hot - 1
    repeated = tw.duplicate_rows(skewed, "rid")
    assert repeated.count() == hot - 1 and repeated.where("rid = 0").count() == 0
    assert tw.drop_duplicates(skewed, "rid").count() == 2 * hot + 1
    flags = dict(rows(tw.duplicate_flags(skewed, "rid").groupBy("is_duplicate").count()))
    assert flags == {"Normal Record": 2 * hot + 1, "Duplicate Footprint": hot - 1}


def test_results_do_not_depend_on_partitions(skewed):
    first = tw.audit(skewed.repartition(3), "rid")
    second = tw.audit(skewed.repartition(17, "v"), "rid")
    exact = [c for c in first.profile.columns if c not in ("mean_value", "std_value")]
    assert rows(first.profile.select(exact)) == rows(second.profile.select(exact))
    assert rows(first.issues) == rows(second.issues)
    assert rows(first.suggestions) == rows(second.suggestions)


def test_a_repaired_table_has_no_findings_left(skewed):
    table = skewed.withColumn("big", F.expr("CASE WHEN rid % 1000 = 1 THEN 1e9D ELSE rid % 50 END"))
    fixed = tw.repair(table, "rid")
    suggested = {(r["column"], r["action_type"]) for r in fixed.suggestions.collect()}
    assert {("All Columns", "DROP_DUPLICATES"), ("v", "FILL_MISSING"), ("big", "CAP_OUTLIERS")} <= suggested
    fences = {r["column"]: r["details"] for r in fixed.suggestions.where("action_type = 'CAP_OUTLIERS'").collect()}
    assert all(r["missing_count"] == 0 for r in by_column(tw.null_counts(fixed.cleaned, "rid")).values())
    low, high = fences["big"]["lower_fence"], fences["big"]["upper_fence"]
    assert fixed.cleaned.where((F.col("big") < low) | (F.col("big") > high)).count() == 0
    log = by_column(fixed.change_log)
    # Ten of the thirty extreme rows are copies of each other.
    assert log["big"]["modified"] == 21 and log["v"]["filled"] == 10_000
    assert rows(tw.change_log(table, fixed.cleaned, "rid")) == rows(fixed.change_log)


def test_wide_table(spark):
    """More columns than fit one pass."""
    wide = spark.range(0, 500).selectExpr(
        "id AS rid",
        *[f"CASE WHEN id % {i + 2} = 0 THEN NULL ELSE id + {i} END AS n{i}" for i in range(60)],
        *[f"CAST(id % {i + 1} AS STRING) AS s{i}" for i in range(50)],
    )
    found = by_column(tw.enriched_profile(wide, "rid", with_top_values=False))
    assert len(found) == 110
    for i in (0, 17, 59):
        assert found[f"n{i}"]["missing_count"] == len(range(0, 500, i + 2))
        assert found[f"n{i}"]["unique_count"] == 500 - len(range(0, 500, i + 2))
    assert [found[f"s{i}"]["unique_count"] for i in (0, 9, 49)] == [1, 10, 50]


def test_table_without_columns(spark):
    assert rows(tw.enriched_profile(spark.range(3).select())) == []


def shuffled_bytes(spark) -> int:
    """Bytes that all stages of the session have written to shuffles so far."""
    store, total = spark.sparkContext._jsc.sc().statusStore(), 0
    stages = store.stageList(spark.sparkContext._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    for i in range(stages.size()):
        total += stages.apply(i).shuffleWriteBytes()
    return total


def test_texts_that_begin_alike_do_not_travel(spark):
    """Only beginnings are sent of texts that tie in count and in their first 200 characters."""
    body = "repeat(sha2(CAST(id AS STRING), 512), 100)"
    pages = spark.range(0, 10_000, 1, 8).selectExpr(f"repeat('same start', 20) || {body} AS html").checkpoint()
    before = shuffled_bytes(spark)
    found = tw.top_values(pages).orderBy("rank").collect()
    sent = shuffled_bytes(spark) - before
    assert [r["value"] for r in found] == [r[0] for r in pages.orderBy("html").limit(5).collect()]
    size = 200 + 12_800
    assert sent < 1000 * size


@pytest.mark.parametrize("same", [10, 63, 64, 65, 319, 320, 321, 5000])
def test_top_values_of_texts_that_begin_alike(spark, same):
    """Ties that end before, at and after the characters of every step; some texts stand twice."""
    texts = [("é" * same) + f"{(i * 37) % 101:03d}" + "x" * (i % 90) for i in range(100)]
    texts += [texts[3], texts[50], "é" * same, "é" * 64, "b", "b"]
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)], "rid int, t string, u string")
    found = by_rank = {}
    for r in tw.top_values(df, "rid", 7).collect():
        by_rank.setdefault(r["column"], {})[r["rank"]] = (r["value"], r["count"])
    for place, name in ((1, "t"), (2, "u")):
        count = {}
        for row in df.collect():
            count[row[place]] = count.get(row[place], 0) + 1
        want = sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[:7]
        assert [found[name][k] for k in range(1, 8)] == want
