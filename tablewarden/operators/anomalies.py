"""Pattern anomalies: empty columns, all-zero columns, mixed numbers, bad addresses and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import audited_columns
from ..functions.sqltext import array, struct, text
from .profile import PATTERNS, column_facts
from .rows import normalise_nulls

NULL_COLUMN = "null_column"
ZERO_COLUMN = "zero_column"
MIXED_NUMERIC = "mixed_numeric"
MALFORMED_EMAIL = "malformed_email"
UNREADABLE_DATE = "unreadable_date"

# The issue texts of type mismatches.
ISSUE_TEXTS = {
    MIXED_NUMERIC: "Mixed numeric and text patterns detected",
    MALFORMED_EMAIL: "Malformed structural email patterns",
    UNREADABLE_DATE: "Multi-format timeline sequences or corrupted string literals",
}


# Rows that fail a pattern check; a row that fails two checks counts twice, up to the rows of the table.
MISMATCH_COUNT = (
    "least(CASE WHEN number_texts < total_rows - missing_count THEN number_texts ELSE 0 END "
    "+ coalesce(bad_emails, 0) + coalesce(bad_dates, 0), total_rows)"
)


def anomalies_of(facts: DataFrame) -> DataFrame:
    """Anomalies told by the per-column facts: (position, column, kind, issue, affected_rows)."""
    filled = "(total_rows - missing_count)"
    checks = [
        (NULL_COLUMN, f"total_rows > 0 AND {filled} = 0", "total_rows"),
        (ZERO_COLUMN, f"{filled} > 0 AND zero_count = {filled}", filled),
        (MIXED_NUMERIC, f"number_texts > 0 AND number_texts < {filled}", "number_texts"),
        (MALFORMED_EMAIL, "bad_emails > 0", "bad_emails"),
        (UNREADABLE_DATE, "bad_dates > 0", "bad_dates"),
    ]
    found = [
        f"CASE WHEN {holds} THEN {struct({'kind': text(kind), 'issue': text(ISSUE_TEXTS.get(kind)), 'affected_rows': rows})} END"
        for kind, holds, rows in checks
    ]
    return facts.selectExpr("position", "column", f"inline(array_compact({array(found)}))")


def anomalies(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """All pattern anomalies of a table, from one aggregate over one scan."""
    df = normalise_nulls(df)
    return anomalies_of(column_facts(df, audited_columns(df, row_id), frozenset({PATTERNS})))
