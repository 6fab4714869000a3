"""Column metadata: type classes, safe names and small helpers over schemas."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sqltext import quote

NUMERIC = "numeric"
BOOLEAN = "boolean"
TEMPORAL = "temporal"
STRING = "string"
OTHER = "other"

_TEMPORAL_TYPES = (
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.TimeType,
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
    T.CalendarIntervalType,
)


@dataclass(frozen=True)
class AuditColumn:
    """One audited column: its position among the audited columns, name and type."""

    position: int
    name: str
    data_type: T.DataType

    @property
    def type_class(self) -> str:
        return type_class(self.data_type)

    @property
    def dtype(self) -> str:
        return self.data_type.simpleString()

    @property
    def value(self) -> Column:
        return column(self.name)

    @property
    def sql(self) -> str:
        """The column in SQL text."""
        return quote(self.name)


def type_class(data_type: T.DataType) -> str:
    """Class of a type; the rules of every operator branch on it."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, _TEMPORAL_TYPES):
        return TEMPORAL
    # Char and varchar are separate classes from string; untyped (all null) columns read as string.
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType, T.NullType)):
        return STRING
    return OTHER


def column(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or back-ticks."""
    return F.col(quote(name))


def audited_columns(df: DataFrame, row_id: str | None = None) -> list[AuditColumn]:
    """Columns under audit: all but the row identity."""
    fields = [f for f in df.schema.fields if f.name != row_id]
    return [AuditColumn(i, f.name, f.dataType) for i, f in enumerate(fields)]


def numeric_columns(columns: Iterable[AuditColumn]) -> list[AuditColumn]:
    return [c for c in columns if c.type_class == NUMERIC]


def batches(items: Sequence, size: int) -> Iterator[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
