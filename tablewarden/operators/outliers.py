"""Values outside the quartile fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownColumnError
from ..functions.columns import AuditColumn, audited_columns, batches, union_all
from ..functions.sqltext import array, double, quote, struct, text
from ..settings import DEFAULTS, Settings
from .profile import COLUMNS_PER_PASS
from .quantiles import Fences, fences_by_column
from .rows import normalise_nulls

OUTLIER_FIELDS = [
    T.StructField("outlier_count", T.LongType()),
    T.StructField("lower_fence", T.DoubleType()),
    T.StructField("upper_fence", T.DoubleType()),
]
_COUNT_SCHEMA = "position int, column string, outlier_count bigint, lower_fence double, upper_fence double"


def outside(value: str, fences: Fences) -> str:
    """Whether a value lies outside usable fences; null for null."""
    return f"({value} < {double(fences.lower)} OR {value} > {double(fences.upper)})"


def selected_columns(
    df: DataFrame, row_id: str | None, columns: Sequence[str] | None
) -> list[AuditColumn]:
    """The audited columns asked for, all by default; unknown names fail before any job."""
    available = audited_columns(df, row_id)
    if columns is None:
        return available
    unknown = [name for name in columns if name not in {c.name for c in available}]
    if unknown:
        raise UnknownColumnError(f"columns not in the table: {unknown}")
    return [c for c in available if c.name in columns]


def count_outside(df: DataFrame, columns: list[AuditColumn], fences: dict[str, Fences]) -> DataFrame:
    """Outlier count and fences per column, all columns in one aggregate."""
    if not columns:
        return df.sparkSession.createDataFrame([], _COUNT_SCHEMA)
    parts = []
    for group in batches(columns, COLUMNS_PER_PASS):
        rows = []
        for c in group:
            f = fences[c.name]
            n = f"count_if({outside(f'CAST({c.sql} AS DOUBLE)', f)})" if f.usable else "0"
            row = {
                "position": str(c.position),
                "column": text(c.name),
                "outlier_count": f"CAST({n} AS BIGINT)",
                "lower_fence": double(f.lower),
                "upper_fence": double(f.upper),
            }
            rows.append(struct(row))
        parts.append(df.agg(F.expr(array(rows)).alias("found")).selectExpr("inline(found)"))
    return union_all(parts)


def outlier_counts(
    df: DataFrame,
    row_id: str | None = None,
    columns: Sequence[str] | None = None,
    multiplier: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Outlier count and fences per column; other than numeric columns report 0."""
    df = normalise_nulls(df)
    chosen = selected_columns(df, row_id, columns)
    fences = fences_by_column(df, chosen, settings.iqr_multiplier if multiplier is None else multiplier)
    return count_outside(df, chosen, fences)


def outlier_rows(
    df: DataFrame,
    row_id: str,
    columns: Sequence[str] | None = None,
    multiplier: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(row id, column, value) of every outlier; a projection over one scan, without shuffle."""
    df = normalise_nulls(df)
    chosen = selected_columns(df, row_id, columns)
    fences = fences_by_column(df, chosen, settings.iqr_multiplier if multiplier is None else multiplier)
    flags = []
    for c in chosen:
        if fences[c.name].usable:
            value = f"CAST({c.sql} AS DOUBLE)"
            found = struct({"column": text(c.name), "value": value})
            flags.append(f"CASE WHEN {outside(value, fences[c.name])} THEN {found} END")
    if not flags:
        return df.selectExpr(quote(row_id), "'' AS column", "0.0D AS value").where("false")
    return df.selectExpr(quote(row_id), f"inline(array_compact({array(flags)}))")
