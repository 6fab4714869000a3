"""Repeated rows.

Rows are compared on compact keys, counted before and after the shuffle, so one row repeated over a
third of a table reaches its reducer as one record per task. Row-level results are built from the
first id of each group and joined on the unique row id, never on the group, which keeps every join
even however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AuditError
from ..functions.columns import AuditColumn, audited_columns, column
from ..functions.ids import new_id_name
from ..functions.sqltext import quote
from .frequency import compact_key, is_text
from .rows import normalise_nulls

# Labels of flagged rows.
NORMAL = "Normal Record"
DUPLICATE = "Duplicate Footprint"


def key_columns(df: DataFrame, row_id: str | None, subset: Sequence[str] | None) -> list[AuditColumn]:
    """Columns that identify a row: all by default; unknown names of a subset are ignored."""
    available = audited_columns(df, row_id)
    if not subset:
        return available
    return [c for c in available if c.name in subset]


def comparable(c: AuditColumn) -> str:
    """The column in a form that groups equal values; nulls equal nulls."""
    if is_text(c.data_type):
        return compact_key(c.sql)
    if isinstance(c.data_type, T.BinaryType):
        return f"CASE WHEN {c.sql} IS NOT NULL THEN sha2({c.sql}, 256) END"
    if isinstance(c.data_type, T.MapType):
        return f"array_sort(map_entries({c.sql}))"
    if isinstance(c.data_type, T.VariantType):
        return f"to_json({c.sql})"
    return c.sql


def _keys(columns: list[AuditColumn]) -> list[str]:
    return [f"{comparable(c)} AS key_{c.position}" for c in columns]


def duplicate_count(df: DataFrame, row_id: str | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    df = normalise_nulls(df)
    columns = key_columns(df, row_id, subset)
    if not columns:
        return df.sparkSession.sql("SELECT 0L AS duplicate_count")
    groups = df.selectExpr(*_keys(columns)).groupBy(*[f"key_{c.position}" for c in columns]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_count"))


def first_ids(df: DataFrame, columns: list[AuditColumn], row_id: str) -> DataFrame:
    """The smallest row id of each group of equal rows, one column of the row id's name."""
    keyed = df.selectExpr(*_keys(columns), f"{quote(row_id)} AS id")
    firsts = keyed.groupBy(*[f"key_{c.position}" for c in columns]).agg(F.min("id").alias("id"))
    return firsts.select(F.col("id").alias(row_id))


def _require_row_id(df: DataFrame, row_id: str | None) -> str:
    if row_id is None or row_id not in df.columns:
        raise AuditError("a unique row id column is required; with_row_id adds one")
    return row_id


def duplicate_rows(df: DataFrame, row_id: str, subset: Sequence[str] | None = None) -> DataFrame:
    """Row ids of all rows that repeat an earlier one: every id that is not the first of its group."""
    df = normalise_nulls(df)
    ids = df.select(column(_require_row_id(df, row_id)))
    columns = key_columns(df, row_id, subset)
    if not columns:
        return ids.where(F.lit(False))
    return ids.join(first_ids(df, columns, row_id), row_id, "left_anti")


def duplicate_flags(df: DataFrame, row_id: str, subset: Sequence[str] | None = None) -> DataFrame:
    """The table with a label that tells repeated rows from normal ones."""
    df = normalise_nulls(df)
    _require_row_id(df, row_id)
    columns = key_columns(df, row_id, subset)
    if not columns:
        return df.withColumn("is_duplicate", F.lit(NORMAL))
    mark = new_id_name(df.columns)
    firsts = first_ids(df, columns, row_id).withColumn(mark, F.lit(True))
    label = f"CASE WHEN {mark} IS NULL THEN '{DUPLICATE}' ELSE '{NORMAL}' END AS is_duplicate"
    return df.join(firsts, row_id, "left").selectExpr(*[quote(c) for c in df.columns], label)


def drop_duplicates(df: DataFrame, row_id: str | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """The table with one row per group, the first by row id.

    Without a row id only whole rows can be compared: the copies are equal, so any may stay.
    """
    df = normalise_nulls(df)
    columns = key_columns(df, row_id, subset)
    if not columns:
        return df
    whole_rows = len(columns) == len(audited_columns(df, row_id))
    if whole_rows and not any(isinstance(c.data_type, (T.MapType, T.VariantType)) for c in columns):
        if row_id is None:
            return df.dropDuplicates()
        kept = df.groupBy(*[c.value for c in columns]).agg(F.min(column(row_id)).alias(row_id))
        return kept.selectExpr(*[quote(c) for c in df.columns])
    row_id = _require_row_id(df, row_id)
    return df.join(first_ids(df, columns, row_id), row_id, "left_semi").selectExpr(*[quote(c) for c in df.columns])
