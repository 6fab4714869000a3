"""Number rules as SQL text: percentages, half-even rounding and two-decimal texts."""

from __future__ import annotations

# Splits a double into two halves whose products are exact (2**27 + 1).
_SPLITTER = "134217729.0D"


def percent(part: str, total: str) -> str:
    """part / total * 100, and 0 for an empty table."""
    return f"CASE WHEN {total} > 0 THEN CAST({part} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0D ELSE 0.0D END"


def whole_score(raw: str) -> str:
    """Half-even rounding to a whole score between 0 and 100."""
    return f"CAST(greatest(0.0D, least(100.0D, rint({raw}))) AS INT)"


def two_decimals(value: str) -> str:
    """Value rounded to two decimals, half-even on the scaled value."""
    return f"(rint(({value}) * 100.0D) / 100.0D)"


def two_decimal_text(value: str) -> str:
    """Non-negative value as text with two decimals, rounded by its exact binary value.

    ``format_string`` rounds the shortest decimal text half up, so 0.125 and 2.675 would print
    differently from C-style formatting. The product with 100 is taken with its exact rounding
    error, which decides the cases that land on a half.
    """
    scaled = f"({value} * 100.0D)"
    high = f"({value} * {_SPLITTER} - ({value} * {_SPLITTER} - {value}))"
    error = f"(({high} * 100.0D - {scaled}) + ({value} - {high}) * 100.0D)"
    cents = (
        f"CAST(CASE WHEN abs({scaled} - floor({scaled})) != 0.5D THEN rint({scaled}) "
        f"WHEN {error} > 0 THEN ceil({scaled}) WHEN {error} < 0 THEN floor({scaled}) ELSE rint({scaled}) END AS BIGINT)"
    )
    return f"concat({cents} DIV 100, '.', lpad({cents} % 100, 2, '0'))"
