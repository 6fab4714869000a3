"""Exact rank selection over numeric columns, and the fences and medians built on it.

Spark's own ``percentile`` interpolates, ``percentile_approx`` is approximate, and ``percentile_disc``
keeps every distinct value of a column in one task. Here the wanted rank is narrowed down by
counting: every pass cuts the bracket that holds the rank into buckets by a monotone function of the
value, counts the buckets with map-side aggregation, and keeps the bucket with the rank. Brackets of
few rows are finished by counting their values directly. All columns and ranks share the passes, and
a pass returns one row per wanted rank.

The search runs on doubles. Whole and decimal numbers that need more digits than a double has are then
told apart among the values with the found double, by whole-number buckets over their digits: one more
pass for bigint, more for long decimals. Their results are decimals and exact in the column's own type.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AuditError
from ..functions.columns import AuditColumn, audited_columns, batches, numeric_columns
from ..functions.local import local_rows
from ..functions.sqltext import array, double, lookup, quote
from ..settings import DEFAULTS, Settings
from .profile import numeric_ranges
from .rows import normalise_nulls

# Buckets per pass: a trillion rows shrink to a few thousand per bracket in about three passes.
BUCKETS = 4096
# A bracket of at most this many rows is ranked by its values.
FINISH_ROWS = 100_000
# Brackets per job; wider tables take several.
BRACKETS_PER_PASS = 80

_LARGEST = sys.float_info.max

# Shapes of a cut: monotone functions of the value, cut into even steps. MAGNITUDE suits most data at
# once; EXPONENT separates any range of magnitudes, however wide; EVEN finishes narrow brackets.
# Each of the first two is used at most once in a row, and an even cut takes twelve of the 53 bits of
# a double, so the number of passes is bounded for any data.
MAGNITUDE, EXPONENT, EVEN = "magnitude", "exponent", "even"
# -ln of the smallest positive double, rounded up: no value of another sign than zero maps to zero.
_TINY = 745.0


@dataclass(frozen=True)
class _Search:
    """One wanted 0-based rank and the bracket of values known to hold it."""

    column: str
    rank: int
    low: float
    high: float
    rows: int  # rows inside the bracket
    below: int = 0  # rows under the bracket
    shape: str = MAGNITUDE  # of the next cut
    stuck: bool = False  # an even cut did not narrow the bracket

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high

    @property
    def found(self) -> bool:
        return self.low == self.high


def _place(value: float, shape: str) -> float:
    """The shape function on the driver, for the ends of a bracket."""
    if shape == MAGNITUDE:
        return math.copysign(math.log1p(abs(value)), value)
    if shape == EXPONENT:
        return math.copysign(math.log(abs(value)) + _TINY, value) if value else 0.0
    return value * 0.5


_PLACES = {
    MAGNITUDE: "signum(value) * log1p(abs(value))",
    EXPONENT: f"CASE WHEN value = 0 THEN 0.0D ELSE signum(value) * (ln(abs(value)) + {double(_TINY)}) END",
    EVEN: "value * 0.5D",
}


def _next_shape(shape: str, low: float, high: float) -> str:
    same_magnitude = 0 < low and high <= 4 * low or high < 0 and low >= 4 * high
    return EVEN if same_magnitude or shape == EXPONENT else EXPONENT


def _bucket(low: str, scale: str, shape: str) -> str:
    """Bucket of a value. Infinite values get the buckets -1 and BUCKETS of their own."""
    return (
        f"CASE WHEN value = double('Infinity') THEN {BUCKETS} WHEN value = double('-Infinity') THEN -1 "
        f"ELSE CAST(least(greatest(floor(({_PLACES[shape]} - {low}) * {scale}), 0), {BUCKETS - 1}) AS INT) END"
    )


def _scaling(low: float, high: float, shape: str) -> tuple[float, float]:
    """Offset and factor that map the bracket to the buckets."""
    start, end = _place(max(low, -_LARGEST), shape), _place(min(high, _LARGEST), shape)
    scale = BUCKETS / (end - start) if end > start else 0.0
    return start, scale if math.isfinite(scale) else 0.0


def _pass(df: DataFrame, searches: list[_Search], shape: str | None) -> list[_Search]:
    """One job over all brackets: cut them into buckets by a shape, or count their single values."""
    brackets = sorted({s.bracket for s in searches})
    slots = {bracket: i for i, bracket in enumerate(brackets)}
    inside = []
    for i, (name, low, high) in enumerate(brackets):
        value = f"CAST({quote(name)} AS DOUBLE)"
        inside.append(f"CASE WHEN {value} BETWEEN {double(low)} AND {double(high)} THEN {value} END AS `{i}`")
    values = (
        df.selectExpr(*inside)
        .unpivot([], [str(i) for i in range(len(brackets))], "slot", "value")
        .where("value IS NOT NULL")
    )
    if shape is not None:
        scaled = [_scaling(low, high, shape) for _, low, high in brackets]
        low = lookup([double(a) for a, _ in scaled], "slot")
        scale = lookup([double(b) for _, b in scaled], "slot")
        counted = (
            values.selectExpr("CAST(slot AS INT) AS slot", "value")
            .selectExpr("slot", "value", f"{_bucket(low, scale, shape)} AS bucket")
            .groupBy("slot", "bucket")
            .agg(F.expr("count(1) AS rows"), F.expr("min(value) AS low"), F.expr("max(value) AS high"))
        )
        order = "bucket"
    else:
        counted = (
            values.selectExpr("CAST(slot AS INT) AS slot", "value AS low")
            .groupBy("slot", "low")
            .agg(F.expr("count(1) AS rows"))
            .withColumn("high", F.col("low"))
        )
        order = "low"
    ranks = [sorted({s.rank - s.below for s in searches if s.bracket == b}) for b in brackets]
    wanted = lookup([array([f"{r}L" for r in rs]) for rs in ranks], "slot")
    # A window holds the buckets of one bracket, or the values of a bracket of few rows.
    hits = (
        counted.selectExpr("*", f"sum(rows) OVER (PARTITION BY slot ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS end")
        .selectExpr("slot", "low", "high", "rows", "end - rows AS start", "end")
        .where(f"exists({wanted}, r -> r >= start AND r < end)")
        .collect()
    )
    narrowed = []
    for s in searches:
        offset = s.rank - s.below
        hit = next(
            (h for h in hits if h["slot"] == slots[s.bracket] and h["start"] <= offset < h["start"] + h["rows"]), None
        )
        if hit is None:
            raise AuditError("the table changed between two reads; write or checkpoint it before the audit")
        narrowed.append(
            replace(
                s,
                low=hit["low"],
                high=hit["high"],
                rows=hit["rows"],
                below=s.below + hit["start"],
                shape=_next_shape(s.shape, hit["low"], hit["high"]),
                stuck=shape == EVEN and (hit["low"], hit["high"]) == (s.low, s.high),
            )
        )
    return narrowed


def _select(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], _Search]:
    """The finished search of each wanted rank."""
    done = [s for s in searches if s.found]
    open_ = [s for s in searches if not s.found]

    def ready(s: _Search) -> bool:
        # A bracket that an even cut does not narrow spans a handful of neighbouring doubles.
        return s.rows <= FINISH_ROWS or s.stuck

    while large := [s for s in open_ if not ready(s)]:
        open_ = [s for s in open_ if ready(s)]
        for shape in (MAGNITUDE, EXPONENT, EVEN):
            for group in batches([s for s in large if s.shape == shape], BRACKETS_PER_PASS):
                moved = _pass(df, list(group), shape)
                done += [s for s in moved if s.found]
                open_ += [s for s in moved if not s.found]
    # All brackets that are left share the last pass.
    for group in batches(open_, BRACKETS_PER_PASS):
        done += _pass(df, list(group), None)
    return {(s.column, s.rank): s for s in done}


# Largest numbers without a fraction that doubles tell apart, for whole and for decimal numbers.
_WHOLE_DIGITS, _DECIMAL_DIGITS = 2**53, 10**15


def _scale(c: AuditColumn) -> int:
    return c.data_type.scale if isinstance(c.data_type, T.DecimalType) else 0


def _needs_digits(c: AuditColumn, low: float, high: float) -> bool:
    """Whether doubles do not tell the column's values apart."""
    largest = max(abs(low), abs(high))
    if isinstance(c.data_type, T.DecimalType):
        return largest * 10.0 ** _scale(c) >= _DECIMAL_DIGITS
    return isinstance(c.data_type, T.IntegralType) and largest >= _WHOLE_DIGITS


@dataclass(frozen=True)
class _Digits:
    """A rank among the values that are one double: the digits, as a whole number, lie between ``low`` and ``high``."""

    column: AuditColumn
    rank: int
    real: float
    low: int
    high: int
    below: int

    @property
    def bracket(self) -> tuple[str, float, int, int]:
        return self.column.name, self.real, self.low, self.high

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BUCKETS)


def _digits_of(c: AuditColumn) -> str:
    """The number without its decimal point."""
    plain = f"regexp_replace(CAST({c.sql} AS STRING), '[.]', '')" if _scale(c) else c.sql
    return f"CAST({plain} AS DECIMAL(38, 0))"


def _digits_around(c: AuditColumn, real: float) -> tuple[int, int]:
    """Digits of all numbers that may be this double."""
    ends = (Fraction(real) + side * Fraction(math.ulp(real)) for side in (-1, 1))
    low, high = (end * 10 ** _scale(c) for end in ends)
    limit = 10**38 - 1
    return max(math.floor(low), -limit), min(math.ceil(high), limit)


def _exact_values(df: DataFrame, searches: list[_Digits]) -> dict[tuple[str, int], Decimal]:
    """The value of each search, in the digits of its column; all searches share the passes."""
    found: dict[tuple[str, int], Decimal] = {}
    while searches:
        for s in searches:
            if s.low == s.high:
                found[s.column.name, s.rank] = Decimal((s.low < 0, tuple(map(int, str(abs(s.low)))), -_scale(s.column)))
        searches = [s for s in searches if s.low < s.high]
        narrowed = []
        for group in batches(searches, BRACKETS_PER_PASS):
            slots = {bracket: i for i, bracket in enumerate(sorted({s.bracket for s in group}))}
            inside = {}
            for s in group:
                digits = _digits_of(s.column)
                bucket = f"CAST(({digits} - CAST('{s.low}' AS DECIMAL(38, 0))) div CAST('{s.width}' AS DECIMAL(38, 0)) AS INT)"
                within = f"{digits} BETWEEN CAST('{s.low}' AS DECIMAL(38, 0)) AND CAST('{s.high}' AS DECIMAL(38, 0))"
                # The digits are taken of the values with this double only.
                inside[slots[s.bracket]] = f"CASE WHEN CAST({s.column.sql} AS DOUBLE) = {double(s.real)} THEN CASE WHEN {within} THEN {bucket} END END AS `{slots[s.bracket]}`"
            counted = (
                df.selectExpr(*[inside[i] for i in range(len(slots))])
                .unpivot([], [str(i) for i in range(len(slots))], "slot", "bucket")
                .where("bucket IS NOT NULL")
                .selectExpr("CAST(slot AS INT) AS slot", "bucket")
                .groupBy("slot", "bucket")
                .agg(F.expr("count(1) AS rows"))
            )
            ranks = [sorted({s.rank - s.below for s in group if slots[s.bracket] == i}) for i in range(len(slots))]
            wanted = lookup([array([f"{r}L" for r in rs]) for rs in ranks], "slot")
            hits = (
                counted.selectExpr("*", "sum(rows) OVER (PARTITION BY slot ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS end")
                .selectExpr("slot", "bucket", "end - rows AS start", "end")
                .where(f"exists({wanted}, r -> r >= start AND r < end)")
                .collect()
            )
            for s in group:
                hit = next((h for h in hits if h["slot"] == slots[s.bracket] and h["start"] <= s.rank - s.below < h["end"]), None)
                if hit is None:
                    raise AuditError("the table changed between two reads; write or checkpoint it before the audit")
                low = s.low + hit["bucket"] * s.width
                narrowed.append(replace(s, low=low, high=min(low + s.width - 1, s.high), below=s.below + hit["start"]))
        searches = narrowed
    return found


def values_at_ranks(
    df: DataFrame,
    columns: list[AuditColumn],
    ranks: Callable[[int], Iterable[int]],
    ranges: dict[str, tuple[int, float | None, float | None]] | None = None,
) -> dict[str, list[float | Decimal]]:
    """For each numeric column with values: the values at ``ranks(number of values)``.

    They are doubles, or decimals in columns whose values doubles do not tell apart.
    """
    numeric = numeric_columns(columns)
    if not numeric:
        return {}
    ranges = ranges if ranges is not None else numeric_ranges(df, numeric)
    wanted = {c.name: list(ranks(ranges[c.name][0])) for c in numeric if ranges[c.name][0] > 0}
    searches = {
        (name, rank): _Search(name, rank, ranges[name][1], ranges[name][2], ranges[name][0])
        for name, found in wanted.items()
        for rank in found
    }
    selected = _select(df, list(searches.values()))
    values: dict[tuple[str, int], float | Decimal] = {key: s.low for key, s in selected.items()}
    long = {c.name: c for c in numeric if c.name in wanted and _needs_digits(c, *ranges[c.name][1:])}
    values |= _exact_values(df, [_Digits(long[name], rank, s.low, *_digits_around(long[name], s.low), s.below) for (name, rank), s in selected.items() if name in long])
    return {name: [values[name, rank] for rank in found] for name, found in wanted.items()}


def nearest_rank(n: int, quantile: float) -> int:
    """0-based rank of the nearest-rank quantile of n values."""
    return math.floor((n - 1) * quantile + 0.5)


@dataclass(frozen=True)
class Fences:
    q25: float | None = None
    q75: float | None = None
    lower: float = 0.0
    upper: float = 0.0
    usable: bool = False  # whether values are compared with the fences at all


def fences_by_column(
    df: DataFrame,
    columns: list[AuditColumn],
    multiplier: float,
    ranges: dict[str, tuple[int, float | None, float | None]] | None = None,
) -> dict[str, Fences]:
    """Quartile fences of the numeric columns; 0 and 0 where there is nothing to fence."""
    quartiles = values_at_ranks(df, columns, lambda n: (nearest_rank(n, 0.25), nearest_rank(n, 0.75)), ranges)
    fences = {}
    for c in columns:
        if c.name not in quartiles:
            fences[c.name] = Fences()
            continue
        q25, q75 = quartiles[c.name]
        with localcontext(prec=100):
            reach = (Decimal(repr(multiplier)) if isinstance(q25, Decimal) else multiplier) * (q75 - q25)
            lower, upper = float(q25 - reach), float(q75 + reach)
        q25, q75 = float(q25), float(q75)
        finite = math.isfinite(lower) and math.isfinite(upper)
        fences[c.name] = Fences(q25, q75, lower, upper, True) if finite else Fences(q25, q75)
    return fences


def medians_by_column(df: DataFrame, columns: list[AuditColumn]) -> dict[str, float | Decimal]:
    """Median of each numeric column with values: the middle value, or the mean of the middle two."""
    middles = values_at_ranks(df, columns, lambda n: ((n - 1) // 2, n // 2))
    with localcontext(prec=100):
        return {name: low if low == high else (low + high) / 2 for name, (low, high) in middles.items()}


def iqr_fences(
    df: DataFrame,
    row_id: str | None = None,
    multiplier: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Quartiles and outlier fences per column, by nearest rank, each rounded to a double once."""
    df = normalise_nulls(df)
    columns = audited_columns(df, row_id)
    found = fences_by_column(df, columns, settings.iqr_multiplier if multiplier is None else multiplier)
    rows = [(c.position, c.name, found[c.name].q25, found[c.name].q75, found[c.name].lower, found[c.name].upper) for c in columns]
    return local_rows(
        df,
        rows,
        "position int, column string, q25 double, q75 double, lower_fence double, upper_fence double",
    )


def medians(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Median per numeric column, rounded to a double once; null where a column has no values."""
    df = normalise_nulls(df)
    columns = numeric_columns(audited_columns(df, row_id))
    found = medians_by_column(df, columns)
    return local_rows(
        df,
        [(c.position, c.name, float(found[c.name]) if c.name in found else None) for c in columns],
        "position int, column string, median double",
    )


def quantile_values(df: DataFrame, row_id: str | None = None, quantiles: Iterable[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(position, column, quantile, value) by nearest rank per numeric column, the value as text in the column's own type.

    A value is always one of the column's, with all its digits; null where a column has no values.
    """
    df = normalise_nulls(df)
    columns, wanted = numeric_columns(audited_columns(df, row_id)), list(quantiles)
    found = values_at_ranks(df, columns, lambda n: [nearest_rank(n, q) for q in wanted])
    rows = [(c.position, c.name, q, _printed(c, v)) for c in columns for q, v in zip(wanted, found.get(c.name, [None] * len(wanted)), strict=True)]
    return local_rows(df, rows, "position int, column string, quantile double, value string")


def _printed(c: AuditColumn, value: float | Decimal | None) -> str | None:
    if value is None or not isinstance(c.data_type, (T.IntegralType, T.DecimalType)):
        return None if value is None else repr(value)
    with localcontext(prec=100):
        return f"{Decimal(str(value)).quantize(Decimal(1).scaleb(-_scale(c))):f}"
