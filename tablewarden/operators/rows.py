"""Table preparation and row identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import AuditError, UnknownColumnError
from ..functions.columns import column
from ..functions.ids import new_id_name
from ..functions.sqltext import quote
from ..sources.scratch import checkpointed

# monotonically_increasing_id keeps the position inside a partition in its low 33 bits.
_POSITION_MASK = (1 << 33) - 1


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes null in float and double columns; untyped columns become strings."""
    if not isinstance(df, DataFrame):
        raise AuditError(f"expected a Spark DataFrame, got {type(df).__name__}")
    changed = {}
    for f in df.schema.fields:
        name = quote(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            changed[f.name] = f"CASE WHEN NOT isnan({name}) THEN {name} END AS {name}"
        elif isinstance(f.dataType, T.NullType):
            changed[f.name] = f"CAST({name} AS STRING) AS {name}"
    if not changed:
        return df
    return df.selectExpr(*[changed.get(name, quote(name)) for name in df.columns])


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with a generated unique row id in file order, and the name of the id.

    Generated ids depend on the partitioning, so the keyed rows are checkpointed: two plans over
    them, or a retry after a lost executor, always see the same ids. Give a unique column of your
    own wherever there is one; then nothing is written.
    """
    name = new_id_name(df.columns)
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id())), name


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """The table with contiguous 0-based positions in the given order.

    A range shuffle sorts the rows over all partitions; the arrival id splits equal keys, so one
    repeated key never fills a task. Row counts per partition (one small row each) give the offsets.
    """
    unknown = [c for c in order_by if c not in df.columns]
    if unknown or not order_by:
        raise UnknownColumnError(f"order columns must name columns of the table: {unknown}")
    arrival = new_id_name(df.columns)
    part = new_id_name([*df.columns, arrival])
    local = new_id_name([*df.columns, arrival, part])
    offset = new_id_name([*df.columns, arrival, part, local])
    keys = [*[column(c) for c in order_by], column(arrival)]
    placed = checkpointed(
        df.withColumn(arrival, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id())
        .withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
        .drop(arrival)
    )
    # One row per shuffle partition, so both the window and the broadcast stay small.
    counts = placed.groupBy(column(part)).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(column(part)).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(column(part), F.coalesce(before, F.lit(0)).alias(offset))
    position = (column(offset) + column(local)).cast("bigint").alias(name)
    return placed.join(F.broadcast(offsets), on=part).select(position, *[column(c) for c in df.columns])
