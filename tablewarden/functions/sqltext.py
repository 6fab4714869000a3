"""SQL text for per-column expressions.

Aggregates over wide tables consist of many small expressions that differ only by column. Written as
SQL text they are handed to Spark in one piece; built call by call from Python, planning them would
take longer than running them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence


def quote(name: str) -> str:
    """Identifier, also for names with dots or back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str | None) -> str:
    """String literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """Raw string literal for a regular expression without quotes."""
    return f"r'{regex}'"


def double(value: float | None) -> str:
    """Double literal that reads back as the same number."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if math.isfinite(value):
        return f"{float(value)!r}D"
    return f"CAST('{value}' AS DOUBLE)"


def struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{text(name)}, {value}" for name, value in fields.items()) + ")"


def array(items: Sequence[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def lookup(items: Sequence[str], index: str) -> str:
    """The item at a 0-based index expression."""
    return f"element_at({array(items)}, {index} + 1)"
