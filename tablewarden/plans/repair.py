"""Repair of a table: audit, suggested fixes, repaired table and change log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.remedies import apply_fixes_with_log, suggest_fixes, suggestions_of
from ..settings import DEFAULTS, Settings
from .audit import enriched_profile


@dataclass(frozen=True)
class Repair:
    """``cleaned`` and ``change_log`` are lazy plans over the kept rows, which are written once."""

    cleaned: DataFrame
    change_log: DataFrame
    suggestions: DataFrame


def repair(df: DataFrame, row_id: str | None = None, settings: Settings = DEFAULTS) -> Repair:
    """Apply every suggested fix; repeated rows are those of the settings' duplicate subset."""
    enriched = enriched_profile(df, row_id, settings, with_top_values=False)
    cleaned, log = apply_fixes_with_log(df, suggestions_of(enriched), row_id, settings.subset)
    return Repair(cleaned, log, suggest_fixes(enriched))
