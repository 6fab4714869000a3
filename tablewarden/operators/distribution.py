"""Histograms of numeric columns and where their values fall against the fences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AuditColumn, batches, numeric_columns, union_all
from ..functions.local import local_rows
from ..functions.sqltext import double, lookup, quote, text
from ..settings import DEFAULTS, Settings
from .outliers import selected_columns
from .profile import COLUMNS_PER_PASS, numeric_ranges
from .quantiles import Fences, fences_by_column
from .rows import normalise_nulls

# Bins of a histogram and the bands around the fences.
BINS = 40
LOWER, INLIER, UPPER = "lower", "inlier", "upper"

_SCHEMA = "column string, bin int, bin_start double, bin_end double, count bigint"
_BAND_SCHEMA = "column string, bin int, band string, count bigint"


def _finite(c: AuditColumn) -> str:
    value = f"CAST({c.sql} AS DOUBLE)"
    return f"CASE WHEN {value} > double('-Infinity') AND {value} < double('Infinity') THEN {value} END"


def _edges(low: float, high: float, bins: int) -> tuple[float, int]:
    """Bin width and number of bins; a single bin where all values are equal."""
    width = (high - low) / bins
    return (width, bins) if math.isfinite(width) and width > 0 else (0.0, 1)


def _cell(name: str, low: float, high: float, bins: int, fences: Fences | None) -> str:
    """Bin and band of a value as one number, so that a batch unpivots to a single column."""
    value = quote(name)
    width, n = _edges(low, high, bins)
    place = f"least(greatest(floor(({value} - {double(low)}) / {double(width)}), 0), {n - 1})" if width else "0"
    band = "1"
    if fences is not None and fences.usable:
        band = f"CASE WHEN {value} < {double(fences.lower)} THEN 0 WHEN {value} > {double(fences.upper)} THEN 2 ELSE 1 END"
    # greatest and least skip nulls, so a missing value is kept out explicitly.
    return f"CASE WHEN {value} IS NOT NULL THEN CAST({place} * 3 + {band} AS INT) END"


def _binned(
    finite: DataFrame, chosen: list[AuditColumn], ranges: dict, bins: int, fences: dict[str, Fences] | None
) -> DataFrame:
    """(column, bin, band, low, width, count); a task sends a few small rows per column."""
    parts = []
    for group in batches(chosen, COLUMNS_PER_PASS):
        limits = [ranges[c.name][1:] for c in group]
        cells = [
            f"{_cell(c.name, *ranges[c.name][1:], bins, fences and fences[c.name])} AS `{i}`"
            for i, c in enumerate(group)
        ]
        slot = "CAST(slot AS INT)"
        parts.append(
            finite.selectExpr(*cells)
            .unpivot([], [str(i) for i in range(len(group))], "slot", "cell")
            .where("cell IS NOT NULL")
            .groupBy("slot", "cell")
            .agg(F.expr("count(1) AS count"))
            .selectExpr(
                f"{lookup([text(c.name) for c in group], slot)} AS column",
                "CAST(floor(cell / 3) AS INT) AS bin",
                f"{lookup([text(b) for b in (LOWER, INLIER, UPPER)], 'cell % 3')} AS band",
                f"{lookup([double(low) for low, _ in limits], slot)} AS low",
                f"{lookup([double(_edges(*limit, bins)[0]) for limit in limits], slot)} AS width",
                "count",
            )
        )
    return union_all(parts)


def _prepared(
    df: DataFrame, row_id: str | None, columns: Sequence[str] | None
) -> tuple[DataFrame, list[AuditColumn], dict]:
    """Finite values of the numeric columns as doubles, the columns that have any, and their ranges."""
    df = normalise_nulls(df)
    numeric = numeric_columns(selected_columns(df, row_id, columns))
    finite = df.selectExpr(*[f"{_finite(c)} AS {c.sql}" for c in numeric]) if numeric else df
    ranges = numeric_ranges(finite, numeric)
    return finite, [c for c in numeric if ranges[c.name][0] > 0], ranges


def histogram(
    df: DataFrame, row_id: str | None = None, columns: Sequence[str] | None = None, bins: int = BINS
) -> DataFrame:
    """Equal-width histogram per numeric column, non-empty bins only; columns without values are left out."""
    finite, chosen, ranges = _prepared(df, row_id, columns)
    if not chosen:
        return local_rows(df, [], _SCHEMA)
    return _binned(finite, chosen, ranges, bins, None).selectExpr(
        "column", "bin", "low + bin * width AS bin_start", "low + (bin + 1) * width AS bin_end", "count"
    )


def histogram_bands(
    df: DataFrame,
    row_id: str | None = None,
    columns: Sequence[str] | None = None,
    multiplier: float | None = None,
    bins: int = BINS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Histogram counts split into values under, inside and over the fences."""
    finite, chosen, ranges = _prepared(df, row_id, columns)
    if not chosen:
        return local_rows(df, [], _BAND_SCHEMA)
    # Fences count every value, infinite ones too, like everywhere else.
    fences = fences_by_column(normalise_nulls(df), chosen, settings.iqr_multiplier if multiplier is None else multiplier)
    return _binned(finite, chosen, ranges, bins, fences).select("column", "bin", "band", "count")


def outlier_bands(
    df: DataFrame,
    row_id: str | None = None,
    columns: Sequence[str] | None = None,
    multiplier: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Value ranges beyond the fences, one row per band that holds values."""
    _, chosen, ranges = _prepared(df, row_id, columns)
    fences = fences_by_column(normalise_nulls(df), chosen, settings.iqr_multiplier if multiplier is None else multiplier)
    rows = []
    for c in chosen:
        (_, low, high), f = ranges[c.name], fences[c.name]
        if f.usable and low < f.lower:
            rows.append((c.name, LOWER, low, f.lower))
        if f.usable and high > f.upper:
            rows.append((c.name, UPPER, f.upper, high))
    return local_rows(df, rows, "column string, band string, band_start double, band_end double")
