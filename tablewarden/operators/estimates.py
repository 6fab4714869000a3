"""Estimated distinct counts from sketches that can be kept and merged.

Exact distinct counts (``frequency``) shuffle every value once. A sketch of a column has a fixed size; tasks
build one each, and sketches of parts of a table (days, shards) are stored and merged later without
reading the parts again. Results say that they are estimates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AuditError
from ..functions.columns import OTHER, AuditColumn, audited_columns, batches, union_all
from ..functions.sqltext import array, struct, text
from .duplicates import comparable
from .rows import normalise_nulls

#: Logarithm of the registers of a sketch: 4,096 registers, about 3 KB a column, 1.6 % of standard error.
PRECISION = 12
_COLUMNS_PER_PASS = 40
_SCHEMA = "position int, column string, precision int, sketch binary"


def _hashed(c: AuditColumn) -> str:
    # Hashes skip nulls inside nested values; their JSON text shows them.
    value = f"to_json(named_struct('v', {comparable(c)}), map('ignoreNullFields', 'false'))" if c.type_class == OTHER else comparable(c)
    return f"CASE WHEN {c.sql} IS NOT NULL THEN xxhash64({value}) END"


def distinct_sketches(df: DataFrame, row_id: str | None = None, precision: int = PRECISION) -> DataFrame:
    """``position``, ``column``, ``precision``, ``sketch`` of the non-null values of every column.

    One aggregate over one scan; a task sends one sketch a column and no values. An empty table gives
    sketches without values. ``precision`` lies from 4 to 21.
    """
    if not 4 <= precision <= 21:
        raise AuditError(f"precision must lie from 4 to 21, not {precision}")
    df = normalise_nulls(df)
    columns = audited_columns(df, row_id)
    if not columns:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    parts = []
    for group in batches(columns, _COLUMNS_PER_PASS):
        rows = [
            struct({"position": str(c.position), "column": text(c.name), "precision": str(precision), "sketch": f"hll_sketch_agg({_hashed(c)}, {precision})"})
            for c in group
        ]
        parts.append(df.agg(F.expr(array(rows)).alias("sketches")).selectExpr("inline(sketches)"))
    return union_all(parts)


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketches of the parts of a table as those of the whole, matched by column name.

    Parts of different precision give the lowest of them.
    """
    if not sketches:
        raise AuditError("give at least one frame of sketches")
    of_column = union_all(list(sketches)).groupBy("column")
    merged = of_column.agg(
        F.min("position").alias("position"), F.min("precision").alias("precision"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch")
    )
    return merged.select("position", "column", "precision", "sketch")


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """``position``, ``column``, ``unique_estimate`` and its ``standard_error``, as a share of the estimate."""
    error = F.lit(1.04) / F.sqrt(F.pow(F.lit(2.0), F.col("precision")))
    return sketches.select("position", "column", F.hll_sketch_estimate("sketch").alias("unique_estimate"), error.alias("standard_error"))
