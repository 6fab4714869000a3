"""Suggested fixes and their application."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import BOOLEAN, NUMERIC, STRING, TEMPORAL, AuditColumn, audited_columns
from ..functions.sqltext import array, double, quote, struct, text
from ..sources.scratch import checkpointed
from .changes import changes_within
from .duplicates import drop_duplicates
from .quantiles import medians_by_column
from .rows import normalise_nulls

# Actions, impacts, texts and fill values.
DROP_DUPLICATES = "DROP_DUPLICATES"
FILL_MISSING = "FILL_MISSING"
CAP_OUTLIERS = "CAP_OUTLIERS"
ALL_COLUMNS = "All Columns"
HIGH, MEDIUM = "High", "Medium"
DROP_TEXT = ("Purge ", " structural multi-row duplicate occurrences across full table index context.")
FILL_TEXT = ("Impute ", " blank missing fields using statistical central tendency configurations.")
CAP_TEXT = ("Clamp ", " variance outliers safely inside calculated IQR constraints boundaries.")
UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Fix:
    column: str
    action_type: str
    lower_fence: float | None = None
    upper_fence: float | None = None


def _suggestion(holds: str, order: int, target: str, action: str, count: str, around: tuple[str, str], impact: str) -> str:
    fill, cap = action == FILL_MISSING, action == CAP_OUTLIERS
    fields = {
        "action_order": str(order),
        "column": target,
        "action_type": text(action),
        "description": f"concat({text(around[0])}, {count}, {text(around[1])})",
        "estimated_impact": text(impact),
        "details": struct(
            {
                "dtype": "dtype" if fill else text(None),
                "lower_fence": "lower_fence" if cap else double(None),
                "upper_fence": "upper_fence" if cap else double(None),
            }
        ),
    }
    return f"CASE WHEN {holds} THEN {struct(fields)} END"


def suggestions_of(enriched: DataFrame) -> DataFrame:
    """Fixes for the findings of an enriched profile, in any order."""
    found = [
        _suggestion(
            "position = 0 AND dataset_duplicate_count > 0",
            0, text(ALL_COLUMNS), DROP_DUPLICATES, "dataset_duplicate_count", DROP_TEXT, HIGH,
        ),
        _suggestion(
            f"missing_count > 0 AND type_class != {text(TEMPORAL)}",
            1, "column", FILL_MISSING, "missing_count", FILL_TEXT, MEDIUM,
        ),
        _suggestion(
            "outlier_count > 0",
            2, "column", CAP_OUTLIERS, "outlier_count", CAP_TEXT, MEDIUM,
        ),
    ]
    return enriched.selectExpr("position", f"inline(array_compact({array(found)}))")


def suggest_fixes(enriched: DataFrame) -> DataFrame:
    """Fixes for the findings of an enriched profile: duplicates first, then the columns in order."""
    return suggestions_of(enriched).orderBy("position", "action_order")


def _as_fixes(fixes: DataFrame | Iterable[Fix | Mapping]) -> list[Fix]:
    """Fixes as plain parameters; a suggestion frame holds at most two rows per column and one more."""
    if isinstance(fixes, DataFrame):
        rows = sorted(fixes.collect(), key=lambda r: (r["position"], r["action_order"]))
        return [
            Fix(r["column"], r["action_type"], r["details"]["lower_fence"], r["details"]["upper_fence"]) for r in rows
        ]
    listed = []
    for f in fixes:
        if isinstance(f, Fix):
            listed.append(f)
            continue
        details = f.get("details") or {}
        listed.append(
            Fix(f.get("column"), f["action_type"], details.get("lower_fence"), details.get("upper_fence"))
        )
    return listed


def _first_per_column(fixes: list[Fix], action: str) -> dict[str, Fix]:
    chosen: dict[str, Fix] = {}
    for f in fixes:
        if f.action_type == action:
            chosen.setdefault(f.column, f)
    return chosen


def _exactly(value: float | Decimal) -> Decimal:
    return value if isinstance(value, Decimal) else Decimal(repr(float(value)))


def _holding(c: AuditColumn, median: float | Decimal) -> T.DataType:
    """The narrowest type like the column's that holds its values and the median exactly.

    A median of whole or decimal values is the mean of two of them, so one more digit is enough.
    """
    kind = c.data_type
    if isinstance(kind, T.IntegralType):
        return kind if _exactly(median) == _exactly(median).to_integral_value() else T.DecimalType(20, 1)
    if isinstance(kind, T.DecimalType) and kind.precision < 38:
        exact = _exactly(median)
        if exact != exact.quantize(Decimal(1).scaleb(-kind.scale), context=Context(prec=400)):
            return T.DecimalType(kind.precision + 1, kind.scale + 1)
    return kind


def _number(value: float | Decimal, kind: T.DataType) -> str:
    """A literal of a numeric type."""
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        unit = Decimal(1).scaleb(-getattr(kind, "scale", 0))
        exact = _exactly(value).quantize(unit, context=Context(prec=400))
        return f"try_cast('{exact:f}' AS {kind.simpleString()})"
    return f"CAST({double(float(value))} AS {kind.simpleString()})"


def _filled(c: AuditColumn, median: float | Decimal | None) -> str:
    """The column with its nulls filled by the rule of its type class; values that are there stay exactly."""
    if c.type_class == NUMERIC:
        kind = _holding(c, median or 0.0)
        return f"coalesce(CAST({c.sql} AS {kind.simpleString()}), {_number(median or 0.0, kind)})"
    if c.type_class == BOOLEAN:
        return f"coalesce({c.sql}, false)"
    if c.type_class == STRING:
        return f"coalesce({c.sql}, {text(UNKNOWN)})"
    # Temporal columns are never imputed, nor are nested ones.
    return c.sql


def _clamped(value: str, kind: T.DataType, fix: Fix) -> str:
    """The value of a numeric type moved inside the fences. Nulls and the type stay.

    For whole and decimal numbers the fences move inward to the next value of the type.
    """
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        exact, unit = Context(prec=400), Decimal(1).scaleb(-getattr(kind, "scale", 0))
        # A fence outside the range of the type is null here and moves nothing.
        lower, upper = (
            f"try_cast('{Decimal(fence).quantize(unit, rounding=side, context=exact):f}' AS {kind.simpleString()})"
            for fence, side in ((fix.lower_fence, ROUND_CEILING), (fix.upper_fence, ROUND_FLOOR))
        )
        return f"CASE WHEN {value} < {lower} THEN {lower} WHEN {value} > {upper} THEN {upper} ELSE {value} END"
    lower, upper = double(fix.lower_fence), double(fix.upper_fence)
    wide = f"CAST({value} AS DOUBLE)"
    moved = f"CASE WHEN {wide} < {lower} THEN {lower} WHEN {wide} > {upper} THEN {upper} ELSE {wide} END"
    return f"CAST({moved} AS {kind.simpleString()})"


def _clampable(c: AuditColumn, fix: Fix | None) -> bool:
    return (
        fix is not None
        and c.type_class == NUMERIC
        and fix.lower_fence is not None
        and fix.upper_fence is not None
        and math.isfinite(fix.lower_fence)
        and math.isfinite(fix.upper_fence)
    )


@dataclass(frozen=True)
class _Plan:
    """Rows kept, and what each column becomes; columns that stay as they are have no entry."""

    kept: DataFrame
    repaired: dict[str, str]

    def cleaned(self) -> DataFrame:
        names = [(name, quote(name)) for name in self.kept.columns]
        return self.kept.selectExpr(*[f"{self.repaired.get(name, sql)} AS {sql}" for name, sql in names])


def _plan(df: DataFrame, fixes: list[Fix], row_id: str | None, subset: list[str] | None) -> _Plan:
    df = normalise_nulls(df)
    columns = audited_columns(df, row_id)
    fills = _first_per_column(fixes, FILL_MISSING)
    caps = _first_per_column(fixes, CAP_OUTLIERS)
    drop = any(f.action_type == DROP_DUPLICATES for f in fixes)
    # Medians, the repaired table and the log all read the kept rows: they are grouped and written once.
    kept = checkpointed(drop_duplicates(df, row_id, subset)) if drop else df
    averaged = [c for c in columns if c.name in fills and c.type_class == NUMERIC]
    medians: dict[str, float | Decimal] = {}
    if averaged:
        medians = medians_by_column(kept, averaged)
    repaired: dict[str, str] = {}
    for c in columns:
        value = c.sql
        if c.name in fills:
            value = _filled(c, medians.get(c.name))
        if _clampable(c, caps.get(c.name)):
            kind = _holding(c, medians.get(c.name) or 0.0) if c.name in fills else c.data_type
            value = _clamped(value, kind, caps[c.name])
        if value != c.sql:
            repaired[c.name] = value
    return _Plan(kept, repaired)


def apply_fixes(
    df: DataFrame,
    fixes: DataFrame | Iterable[Fix | Mapping],
    row_id: str | None = None,
    subset: list[str] | None = None,
) -> DataFrame:
    """The repaired table: duplicates out, then fills and clamps in one projection.

    The first fix per column and action wins. Duplicates are whole rows unless a subset is given.
    """
    return _plan(df, _as_fixes(fixes), row_id, subset).cleaned()


def apply_fixes_with_log(
    df: DataFrame,
    fixes: DataFrame | Iterable[Fix | Mapping],
    row_id: str | None = None,
    subset: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The repaired table and its change log, counted from the same projection without a join."""
    listed = _as_fixes(fixes)
    plan = _plan(df, listed, row_id, subset)
    dropped = any(f.action_type == DROP_DUPLICATES for f in listed)
    log = changes_within(plan.kept, audited_columns(plan.kept, row_id), plan.repaired, df if dropped else None)
    return plan.cleaned(), log
