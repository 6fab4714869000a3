"""Change logs of two tables: digests of id ranges find what has to be joined."""

import random
from decimal import Decimal

import pytest

import tablewarden as tw

from .conftest import DATA, rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


FLAT = {"n": "int", "d": "double", "paint": "string"}
NESTED = FLAT | {"tags": "map<string, int>", "list": "array<int>"}


def random_table(seed, names, size=3000):
    draw = random.Random(seed)
    values = {
        "n": lambda: draw.choice([None, draw.randrange(50)]),
        "d": lambda: draw.choice([None, 0.0, -0.0, float("nan"), draw.random()]),
        "paint": lambda: draw.choice([None, "", "red", "x" * 90 + str(draw.randrange(5))]),
        "tags": lambda: draw.choice([None, {}, {"a": draw.randrange(3)}]),
        "list": lambda: draw.choice([None, [], [None], [1], [None, 1], [1, None]]),
    }
    return {i: {name: values[name]() for name in names} for i in range(size)}, values, draw


def frame(spark, table, types):
    schema = ", ".join(f"{name} {kind}" for name, kind in {"rid": "bigint", **types}.items())
    return spark.createDataFrame([(i, *[row[name] for name in types]) for i, row in table.items()], schema).repartition(3)


def shown(value):
    return None if value is None or value != value else value


def brute(before, after, names):
    log = {name: [0, 0, 0] for name in names}
    for i in before.keys() & after.keys():
        for name in names:
            old, new = shown(before[i][name]), shown(after[i][name])
            if old is None and new is not None:
                log[name][0] += 1
            elif old is not None and new is None:
                log[name][2] += 1
            elif old != new:
                log[name][1] += 1
    return {name: (*held, max(0, len(before) - len(after))) for name, held in log.items()}


def logged(df):
    return {r["column"]: (r["filled"], r["modified"], r["nullified"], r["rows_dropped"]) for r in df.collect()}


@pytest.mark.parametrize("types", [FLAT, NESTED], ids=["flat", "nested"])
@pytest.mark.parametrize(("changed", "dropped"), [(0, 7), (1, 0), (40, 0), (2500, 7)])
def test_same_counts_as_brute_force(spark, changed, dropped, types):
    before, values, draw = random_table(changed + dropped, types)
    after = {i: dict(row) for i, row in before.items()}
    for i in draw.sample(sorted(after), changed):
        name = draw.choice(list(types))
        after[i][name] = values[name]()
    for i in draw.sample(sorted(after), dropped):
        del after[i]
    left, right = frame(spark, before, types), frame(spark, after, types)
    want = brute(before, after, types)
    for ranges in (4096, 1, 0):
        assert logged(tw.change_log(left, right, "rid", ranges)) == want


def test_equal_tables_shuffle_no_row(spark):
    table, *_ = random_table(5, FLAT, 500)
    found = tw.change_log(frame(spark, table, FLAT), frame(spark, table, FLAT), "rid")
    assert {r["mutations"] for r in found.collect()} == {0}
    assert "Exchange" not in plan(found) and "Join" not in plan(found)


def test_only_what_differs_is_joined(spark):
    before = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    after = before.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 97 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice", "o_orderstatus", "o_orderpriority")
    found = tw.change_log(before, after, "o_orderkey")
    text = plan(found)
    assert "INSET" in text.upper() or " IN (" in text
    assert "o_totalprice:double" in text and "o_orderstatus:string" not in text and "o_orderpriority:string" not in text
    changed = before.where("o_orderkey % 97 = 1").count()
    assert changed > 0
    assert logged(found) == {"o_totalprice": (0, changed, 0, 0), "o_orderstatus": (0, 0, 0, 0), "o_orderpriority": (0, 0, 0, 0)}


def test_order_of_rows_and_swapped_values(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "rid int, v string")
    swapped = spark.createDataFrame([(2, "a"), (1, "b"), (None, "c")], "rid int, v string")
    assert rows(tw.change_log(before, swapped, "rid").select("modified")) == [(2,)]
    assert rows(tw.change_log(before, before.orderBy("v", ascending=False), "rid").select("modified")) == [(0,)]


def test_ids_and_values_of_other_types(spark):
    before = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "rid int, k int, big int")
    after = spark.createDataFrame([(1, Decimal("5.0"), 5.0), (2, Decimal("6.5"), 6.25)], "rid bigint, k decimal(8,1), big double")
    for right in (after, after.selectExpr("CAST(rid AS INT) AS rid", "k", "big")):
        assert rows(tw.change_log(before, right, "rid").select("modified")) == [(1,), (1,)]


def test_empty_tables_and_no_columns(spark):
    empty = spark.createDataFrame([], "rid int, v string")
    full = spark.createDataFrame([(1, "a")], "rid int, v string")
    assert rows(tw.change_log(empty, empty, "rid").select("mutations", "rows_dropped")) == [(0, 0)]
    assert rows(tw.change_log(full, empty, "rid").select("mutations", "rows_dropped")) == [(0, 1)]
    assert rows(tw.change_log(empty, full, "rid").select("mutations", "rows_dropped")) == [(0, 0)]
    assert tw.change_log(full.select("rid"), full.select("rid"), "rid").count() == 0
