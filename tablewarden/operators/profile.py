"""Column profile: one wide aggregate for the plain figures, one frequency relation for the values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    NUMERIC,
    OTHER,
    STRING,
    AuditColumn,
    audited_columns,
    batches,
    numeric_columns,
    union_all,
)
from ..functions.numbers import percent
from ..functions.patterns import (
    DATE_NAME_PART,
    EMAIL_NAME_PART,
    is_email,
    reads_as_date,
    reads_as_number,
)
from ..functions.sqltext import array, struct, text
from .frequency import value_summary
from .rows import normalise_nulls

# Columns per aggregate. Spark compiles an aggregate of at most a hundred fields, and a column takes up
# to nine; wider tables are read in several scans of a few columns each.
COLUMNS_PER_PASS = 40
COLUMNS_PER_FULL_PASS = 10

FACTS = {
    "position": "INT",
    "column": "STRING",
    "dtype": "STRING",
    "type_class": "STRING",
    "total_rows": "BIGINT",
    "missing_count": "BIGINT",
    "min_number": "DOUBLE",
    "max_number": "DOUBLE",
    "mean_value": "DOUBLE",
    "std_value": "DOUBLE",
    "zero_count": "BIGINT",
    "min_text": "STRING",
    "max_text": "STRING",
    "number_texts": "BIGINT",
    "bad_emails": "BIGINT",
    "bad_dates": "BIGINT",
}

# Groups of figures; an operator asks only for the ones it reports.
RANGES = "ranges"
MOMENTS = "moments"
PATTERNS = "patterns"
ALL_FIGURES = frozenset({RANGES, MOMENTS, PATTERNS})


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, T.CalendarIntervalType)


def _figures(c: AuditColumn, wanted: frozenset[str]) -> dict[str, str]:
    value, real, name = c.sql, f"CAST({c.sql} AS DOUBLE)", c.name.lower()
    found = {
        "position": str(c.position),
        "column": text(c.name),
        "dtype": text(c.dtype),
        "type_class": text(c.type_class),
        "total_rows": "count(1)",
        "missing_count": f"count_if({value} IS NULL)",
    }
    if c.type_class == NUMERIC:
        if RANGES in wanted:
            found["min_number"] = f"min({value})"
            found["max_number"] = f"max({value})"
        if MOMENTS in wanted:
            found["mean_value"] = f"nullif(avg({real}), CAST('NaN' AS DOUBLE))"
            found["std_value"] = f"nullif(stddev_samp({real}), CAST('NaN' AS DOUBLE))"
        if PATTERNS in wanted:
            found["zero_count"] = f"count_if({value} = 0)"
    elif c.type_class != OTHER and RANGES in wanted and _orderable(c.data_type):
        found["min_text"] = f"min({value})"
        found["max_text"] = f"max({value})"
    if c.type_class == STRING and PATTERNS in wanted:
        found["number_texts"] = f"count_if({reads_as_number(value)})"
        if EMAIL_NAME_PART in name:
            found["bad_emails"] = f"count_if(NOT {is_email(value)})"
        if DATE_NAME_PART in name:
            found["bad_dates"] = f"count_if(NOT {reads_as_date(value)})"
    return found


def _passes(columns: list[AuditColumn], wanted: frozenset[str]) -> Iterator[Sequence[AuditColumn]]:
    """Columns that share an aggregate.

    A text minimum turns the whole aggregate it is part of from hash-based to sort-based, so texts
    keep apart from the fixed-width columns.
    """
    if not wanted:
        yield from batches(columns, COLUMNS_PER_PASS)
        return
    texts = [c for c in columns if c.type_class in (STRING, OTHER)]
    yield from batches([c for c in columns if c not in texts], COLUMNS_PER_FULL_PASS)
    yield from batches(texts, COLUMNS_PER_FULL_PASS)


def column_facts(df: DataFrame, columns: list[AuditColumn], wanted: frozenset[str] = ALL_FIGURES) -> DataFrame:
    """One row of plain figures per column, from global aggregates over disjoint columns.

    An aggregate keeps one small buffer per task and holds no distinct, so no row is expanded.
    ``df`` must have its nulls normalised.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], ", ".join(f"{n} {t}" for n, t in FACTS.items()))
    parts = []
    for group in _passes(columns, wanted):
        found = [_figures(c, wanted) for c in group]
        rows = [struct({n: f"CAST({f.get(n, 'NULL')} AS {t})" for n, t in FACTS.items()}) for f in found]
        parts.append(df.agg(F.expr(array(rows)).alias("figures")).selectExpr("inline(figures)"))
    return union_all(parts)


def null_counts(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Missing values per column, as count and percentage of the rows."""
    df = normalise_nulls(df)
    facts = column_facts(df, audited_columns(df, row_id), frozenset())
    return facts.select(
        "position",
        "column",
        "total_rows",
        "missing_count",
        F.expr(MISSING_PERCENTAGE),
    )


def profile(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per column: missing and distinct values, range, moments and the five most frequent values.

    Numeric columns report ``min_number``/``max_number``, all others ``min_text``/``max_text``.
    """
    df = normalise_nulls(df)
    facts = column_facts(df, audited_columns(df, row_id), frozenset({RANGES, MOMENTS}))
    # Both sides hold one row per column, but texts of any length: no broadcast hint.
    return facts.join(value_summary(df, row_id), "position").selectExpr(
        "position",
        "column",
        "dtype",
        "type_class",
        "total_rows",
        "missing_count",
        MISSING_PERCENTAGE,
        "unique_count",
        "min_number",
        "max_number",
        "min_text",
        "max_text",
        "mean_value",
        "std_value",
        "top_values",
    )


MISSING_PERCENTAGE = f"{percent('missing_count', 'total_rows')} AS missing_percentage"


def numeric_ranges(df: DataFrame, columns: list[AuditColumn]) -> dict[str, tuple[int, float | None, float | None]]:
    """Value count, smallest and largest value of each numeric column (one row per column is collected)."""
    rows = column_facts(df, numeric_columns(columns), frozenset({RANGES})).collect()
    return {r["column"]: (r["total_rows"] - r["missing_count"], r["min_number"], r["max_number"]) for r in rows}
