"""What a repair changed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC, OTHER, AuditColumn, audited_columns, batches
from ..functions.sqltext import array, quote, struct, text
from .duplicates import comparable
from .rows import normalise_nulls

# Ranges of hashed row ids whose digests are compared, and columns that one comparison holds.
RANGES = 4096
_COLUMNS_PER_PASS = 40

_SCHEMA = (
    "position int, column string, filled bigint, modified bigint, nullified bigint, mutations bigint, "
    "rows_dropped bigint"
)


def _row(c: AuditColumn, before: str | None, after: str | None, rows_dropped: str) -> str:
    """Counts of null to value, value to other value and value to null."""
    filled = modified = nullified = "0L"
    if before is not None and after is not None:
        filled = f"count_if({before} IS NULL AND {after} IS NOT NULL)"
        modified = f"count_if({before} != {after})"
        nullified = f"count_if({before} IS NOT NULL AND {after} IS NULL)"
    return struct(
        {
            "position": str(c.position),
            "column": text(c.name),
            "filled": filled,
            "modified": modified,
            "nullified": nullified,
            "mutations": f"{filled} + {modified} + {nullified}",
            "rows_dropped": f"CAST(greatest(0, {rows_dropped}) AS BIGINT)",
        }
    )


def _on_common_ground(before: AuditColumn, after: AuditColumn, old: str, new: str) -> tuple[str, str]:
    """The two values in one type that holds both exactly: as they are, as decimals, or as texts."""
    if before.data_type == after.data_type or before.type_class == after.type_class == OTHER:
        return old, new
    if before.type_class == after.type_class == NUMERIC:
        scale = max(_digits(before)[1], _digits(after)[1])
        whole = max(_digits(before)[0], _digits(after)[0])
        if whole + scale <= 38:
            return f"CAST({old} AS DECIMAL({whole + scale}, {scale}))", f"CAST({new} AS DECIMAL({whole + scale}, {scale}))"
        # A double against a whole number or decimal: equal only if both directions agree.
        exact, real = (old, new) if _digits(after)[0] > 38 else (new, old)
        kind = (before if exact == old else after).dtype
        same = f"(CAST({exact} AS DOUBLE) = {real} AND try_cast({real} AS {kind}) = {exact})"
        shown = f"CASE WHEN {{0}} IS NOT NULL THEN CASE WHEN coalesce({same}, false) THEN 0 ELSE {{1}} END END"
        return shown.format(old, 1), shown.format(new, 2)
    return tuple(f"CASE WHEN {v} IS NOT NULL THEN {_shown(c, v)} END" for c, v in ((before, old), (after, new)))


def _shown(c: AuditColumn, value: str) -> str:
    # Long texts and bytes are digests already.
    return f"to_json(named_struct('v', {value}))" if c.type_class == OTHER else f"CAST({value} AS STRING)"


def _digits(c: AuditColumn) -> tuple[int, int]:
    """Digits before and behind the point; more than any decimal holds for binary fractions."""
    kind = c.data_type
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    if isinstance(kind, T.IntegralType):
        return 19, 0
    return 1000, 0


def _log(df: DataFrame, rows: list[str]) -> DataFrame:
    """One aggregate for all columns: what lies under it, a join or a grouping, must not run twice."""
    if not rows:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    return df.agg(F.expr(array(rows)).alias("log")).selectExpr("inline(log)")


def changes_within(
    kept: DataFrame, columns: list[AuditColumn], repaired: dict[str, str], original: DataFrame | None
) -> DataFrame:
    """Change log of a projection over the kept rows: one aggregate, no join.

    ``original`` is the table before duplicates went; None if no row was dropped.
    """
    rows = [_row(c, c.sql if c.name in repaired else None, repaired.get(c.name), "count(1)") for c in columns]
    dropped = F.lit(0).cast("bigint")
    if original is not None:
        dropped = original.agg(F.count(F.lit(1))).scalar() - F.col("rows_dropped")
    return _log(kept, rows).withColumn("rows_dropped", dropped)


def _told_by_digests(before: AuditColumn, after: AuditColumn) -> bool:
    """False where values may differ though each side's hashes agree.

    Hashes skip nulls inside nested values, so ``array(null)`` is like ``array()``; and equality of a double
    and a whole number needs both values.
    """
    if any(isinstance(c.data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for c in (before, after)):
        return False
    if before.data_type == after.data_type or not before.type_class == after.type_class == NUMERIC:
        return True
    whole, scale = (max(_digits(before)[i], _digits(after)[i]) for i in (0, 1))
    return whole + scale <= 38


@dataclass(frozen=True)
class _Difference:
    """Rows of both tables, ranges of ids that hold a difference, and columns that have one."""

    before: int
    after: int
    ranges: set[int]
    columns: set[int]


def _range_of(row_id: str, ranges: int) -> str:
    return f"CAST(pmod(xxhash64({row_id}), {ranges}) AS INT)"


def _digests(df: DataFrame, row_id: str, values: dict[int, str], ranges: int, label: str) -> DataFrame:
    """Per range of hashed ids: rows, and per column two sums (exclusive or) of hashes of id and value, 128 bits."""
    named = df.selectExpr(f"{quote(row_id)} AS id", *[f"{value} AS value_{i}" for i, value in values.items()])
    hashes = [f"bit_xor(xxhash64({salt}id, value_{i} IS NULL, value_{i})) AS {label}_{k}_{i}" for i in values for k, salt in enumerate(("", "1L, "))]
    grouped = named.selectExpr("*", f"{_range_of('id', ranges)} AS range").groupBy("range")
    return grouped.agg(F.count(F.lit(1)).alias(f"{label}_rows"), *[F.expr(h) for h in hashes])


def _difference(original: DataFrame, cleaned: DataFrame, row_id: str, compared: list[tuple[int, str, str]], ranges: int) -> _Difference:
    """Where two tables differ; what comes to the driver is one row with at most ``ranges`` numbers per batch of columns."""
    found = _Difference(0, 0, set(), set())
    for batch in list(batches(compared, _COLUMNS_PER_PASS)) or [[]]:
        before = _digests(original, row_id, {i: old for i, old, _ in batch}, ranges, "before")
        after = _digests(cleaned, row_id, {i: new for i, _, new in batch}, ranges, "after")
        differs = {i: " OR ".join(f"NOT before_{k}_{i} <=> after_{k}_{i}" for k in (0, 1)) for i, *_ in batch}
        any_ = " OR ".join(["NOT before_rows <=> after_rows", *differs.values()])
        row = before.join(after, "range", "full").selectExpr(
            "coalesce(sum(before_rows), 0L)",
            "coalesce(sum(after_rows), 0L)",
            f"collect_list(CASE WHEN {any_} THEN range END)",
            f"array({', '.join(f'coalesce(bool_or({d}), false)' for d in differs.values()) or 'false'})",
        ).first()
        changed = {i for (i, *_), own in zip(batch, row[3], strict=False) if own}
        found = _Difference(row[0], row[1], found.ranges | set(row[2]), found.columns | changed)
    return found


def change_log(original: DataFrame, cleaned: DataFrame, row_id: str, ranges: int = RANGES) -> DataFrame:
    """Change log of any two versions of a table, matched on the unique row id.

    The tables are first compared by digests of ``ranges`` ranges of hashed ids: one aggregate each that
    sends a row per task and range. Only rows of ranges that differ, with only the columns that differ
    somewhere, are joined; columns of nested types are joined in all rows; equal tables shuffle no row. A full join on the id then finds the common rows;
    ids are unique, so the shuffle is even. Columns without a cleaned version report zeros.

    The comparison runs when this is called and reads both tables once more. ``ranges`` 0 leaves it
    out: better where most rows have changed, or where the tables are costly to compute.
    """
    original, cleaned = normalise_nulls(original), normalise_nulls(cleaned)
    columns = audited_columns(original, row_id)
    types = {f.name: f.dataType for f in cleaned.schema.fields}
    shared = {c.position: (c, replace(c, data_type=types[c.name])) for c in columns if c.name in types}
    dropped, keep = "count(in_before) - count(in_after)", None
    # Ids of two types hash differently though they are equal.
    if ranges and types[row_id] == original.schema[row_id].dataType:
        compared = [(i, *_on_common_ground(c, n, comparable(c), comparable(n))) for i, (c, n) in shared.items() if _told_by_digests(c, n)]
        found = _difference(original, cleaned, row_id, compared, ranges)
        told = {i for i, *_ in compared}
        shared = {i: pair for i, pair in shared.items() if i not in told or i in found.columns}
        dropped = f"{found.before - found.after}L"
        if len(found.ranges) < ranges and len(told) == len([c for c in columns if c.name in types]):
            keep = found.ranges
    common = set(shared)
    if keep is not None and not (keep and common):
        rows = array([_row(c, None, None, dropped) for c in columns])
        return original.sparkSession.sql(f"SELECT inline({rows})") if columns else _log(original, [])

    def side(df: DataFrame, label: str, place: int) -> DataFrame:
        if keep is not None:
            df = df.where(f"{_range_of(quote(row_id), ranges)} IN ({', '.join(map(str, sorted(keep)))})")
        values = [f"{comparable(pair[place])} AS {label}_{i}" for i, pair in shared.items()]
        return df.selectExpr(f"{quote(row_id)} AS id", f"true AS in_{label}", *values)

    rows = []
    for c in columns:
        old = new = None
        if c.position in common:
            # Rows on one side only are no changes of values: both sides turn null.
            old, new = (f"CASE WHEN in_before AND in_after THEN {label}_{c.position} END" for label in ("before", "after"))
            old, new = _on_common_ground(*shared[c.position], old, new)
        rows.append(_row(c, old, new, dropped))
    return _log(side(original, "before", 0).join(side(cleaned, "after", 1), "id", "full"), rows)
