"""Where values are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import audited_columns
from ..functions.sqltext import quote
from .rows import normalise_nulls


def missing_matrix(df: DataFrame, row_id: str) -> DataFrame:
    """0/1 per row and column, 1 for a missing value; a projection without shuffle."""
    df = normalise_nulls(df)
    flags = [f"CAST({c.sql} IS NULL AS INT) AS {c.sql}" for c in audited_columns(df, row_id)]
    return df.selectExpr(quote(row_id), *flags)


def missing_blocks(df: DataFrame, row_id: str, block_rows: int = 1000) -> DataFrame:
    """The missingness matrix in blocks of consecutive row ids: rows and missing values per column.

    The row id must be a number. Use it where the table is too long to look at row by row.
    """
    df = normalise_nulls(df)
    block = F.expr(f"CAST(floor({quote(row_id)} / {int(block_rows)}) AS BIGINT) AS row_block")
    sums = [F.expr(f"count_if({c.sql} IS NULL) AS {c.sql}") for c in audited_columns(df, row_id)]
    return df.groupBy(block).agg(F.expr("count(1) AS block_rows"), *sums)
