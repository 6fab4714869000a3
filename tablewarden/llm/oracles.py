"""SQL that the corpus queries must equal, where SQL can say it."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {}
