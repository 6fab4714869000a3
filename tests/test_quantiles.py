"""Rank selection against sorted values, with many passes forced on small data."""

import random
from decimal import Decimal, localcontext

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewarden.functions.columns import audited_columns
from tablewarden.operators import quantiles
from tablewarden.operators.quantiles import fences_by_column, medians_by_column, nearest_rank, quantile_values, values_at_ranks
from tablewarden.operators.remedies import Fix, apply_fixes


@pytest.fixture
def narrow_only(monkeypatch):
    """Brackets are narrowed with few buckets until hardly any row is left."""
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 2)
    monkeypatch.setattr(quantiles, "BUCKETS", 4)


def selected(spark, values, ranks):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return values_at_ranks(df, audited_columns(df), ranks)["v"]


def test_ranks_of_nearest_quantiles():
    assert [nearest_rank(10, q) for q in (0.25, 0.75)] == [2, 7]
    assert [nearest_rank(n, 0.25) for n in (1, 2, 3, 4, 5)] == [0, 0, 1, 1, 1]


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [5.0] * 50,
        [float(i) for i in range(200)],
        [10.0**e for e in range(-150, 150, 3)],
        [-(10.0**e) for e in range(-20, 20)] + [0.0, -0.0, 1.0],
        [float("-inf")] * 3 + [1.0, 2.0] + [float("inf")] * 3,
        [float("-inf"), float("inf")],
        [1.7e308, -1.7e308, 0.0, 5e-324, -5e-324, 1.0, 1.0],
        [1.0 + i * 2.0**-52 for i in range(40)],
        [7.0] * 90 + [6.999999, 7.000001] * 5 + [1e9],
    ],
)
def test_selection_equals_sorting(spark, narrow_only, values):
    random.Random(3).shuffle(values)
    n = len(values)
    wanted = sorted({0, n // 3, n // 2, nearest_rank(n, 0.75), n - 1})
    assert selected(spark, values, lambda _: wanted) == [sorted(values)[k] for k in wanted]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=60))
def test_selection_of_any_doubles(spark, narrow_only, values):
    n = len(values)
    wanted = sorted({nearest_rank(n, 0.25), (n - 1) // 2, n // 2})
    assert selected(spark, values, lambda _: wanted) == [sorted(values)[k] for k in wanted]


def test_integers_and_decimals(spark):
    df = spark.range(0, 1001).selectExpr("id", "CAST(id / 8 AS DECIMAL(10,3)) AS d", "CAST(id % 7 AS TINYINT) AS t")
    columns = audited_columns(df)
    fences = fences_by_column(df, columns, 1.5)
    assert (fences["id"].q25, fences["id"].q75) == (250.0, 750.0)
    assert (fences["d"].q25, fences["d"].q75) == (31.25, 93.75)
    assert (fences["t"].q25, fences["t"].q75) == (1.0, 5.0)
    assert medians_by_column(df, columns) == {"id": 500.0, "d": 62.5, "t": 3.0}


def test_many_columns_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKETS_PER_PASS", 3)
    df = spark.range(0, 100).selectExpr(*[f"id * {i} AS c{i}" for i in range(1, 9)])
    found = medians_by_column(df, audited_columns(df))
    assert found == {f"c{i}": 49.5 * i for i in range(1, 9)}


def test_hot_value(spark):
    """A third of all rows hold one value."""
    df = spark.range(0, 300_000).selectExpr("CASE WHEN id % 3 = 0 THEN 5e5D ELSE CAST(id AS DOUBLE) END AS v")
    values = sorted([5e5 if i % 3 == 0 else float(i) for i in range(300_000)])
    wanted = [0, 74_999, 149_999, 150_000, 225_000, 299_999]
    assert values_at_ranks(df, audited_columns(df), lambda _: wanted)["v"] == [values[k] for k in wanted]


@pytest.mark.parametrize("narrow", [False, True])
@pytest.mark.parametrize(
    "kind, make",
    [
        ("bigint", lambda r: r.choice([9007199254740993 + 2 * r.randrange(40), -(2**63) + r.randrange(3), 2**63 - 1 - r.randrange(5), r.randrange(100)])),
        ("bigint", lambda r: 9007199254740993 + 2 * r.randrange(5)),
        ("decimal(38,0)", lambda r: r.choice([-1, 1]) * (10**38 - 1 - r.randrange(10 ** r.randrange(1, 30)))),
        ("decimal(38,10)", lambda r: Decimal(10**37 + r.randrange(10 ** r.randrange(1, 25))).scaleb(-10)),
        ("decimal(20,3)", lambda r: Decimal(r.choice([-1, 1]) * r.randrange(10**19, 10**19 + 5000)).scaleb(-3)),
        ("decimal(38,38)", lambda r: Decimal(r.randrange(10**37, 10**37 + 10**15)).scaleb(-38)),
    ],
)
def test_ranks_in_the_own_type(spark, monkeypatch, kind, make, narrow):
    """All digits count, with copies, at every rank."""
    if narrow:
        monkeypatch.setattr(quantiles, "FINISH_ROWS", 2)
        monkeypatch.setattr(quantiles, "BUCKETS", 4 if kind == "bigint" else 64)
    r = random.Random(len(kind))
    values = [make(r) for _ in range(60)]
    values += values[:7] * 3
    df = spark.createDataFrame([(Decimal(v) if kind != "bigint" else v,) for v in values] + [(None,)], f"v {kind}")
    columns = audited_columns(df)
    wanted = list(range(0, len(values), 9)) + [len(values) - 1]
    found = values_at_ranks(df, columns, lambda n: wanted)["v"]
    assert [Decimal(f) for f in found] == [Decimal(sorted(values)[k]) for k in wanted]
    with localcontext(prec=100):
        middle = sorted(Decimal(v) for v in values)[(len(values) - 1) // 2], sorted(Decimal(v) for v in values)[len(values) // 2]
        assert medians_by_column(df, columns)["v"] == sum(middle) / 2
    texts = [t["value"] for t in quantile_values(df, quantiles=(0.0, 0.5, 1.0)).collect()]
    n = len(values)
    scale = columns[0].data_type.scale if kind != "bigint" else 0
    assert texts == [f"{Decimal(sorted(values)[k]):.{scale}f}" for k in (0, nearest_rank(n, 0.5), n - 1)]


def test_a_fill_keeps_every_digit(spark):
    rows = [(i, v) for i, v in enumerate([9007199254740993, 9007199254740995, 9007199254740997, 9007199254740999, 9007199254741001, None])]
    df = spark.createDataFrame(rows, "rid int, v bigint")
    filled = apply_fixes(df, [Fix("v", "FILL_MISSING")], "rid")
    assert filled.dtypes == df.dtypes and filled.where("rid = 5").first()["v"] == 9007199254740997
    halves = df.union(spark.sql("SELECT 6, 9007199254740998L"))
    filled = apply_fixes(halves, [Fix("v", "FILL_MISSING")], "rid")
    assert filled.where("rid = 5").first()["v"] == Decimal("9007199254740997.5")
