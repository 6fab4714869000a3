"""Small per-column results as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_rows(df: DataFrame, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A frame of a few rows (one per column of a table), planned as a local table without tasks."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = [dict(zip(schema.names, row, strict=True)) for row in rows]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(schema))
    return df.sparkSession.createDataFrame(table, schema=schema)
