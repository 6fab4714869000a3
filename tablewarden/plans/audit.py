"""Audit of a table: from the table to findings, scores, issues and suggested fixes.

The table is read by one query whose independent stages (plain figures, value frequencies, duplicate
groups) run side by side, a few narrowing passes over the numeric columns for the fences, and the outlier
counts. Wide tables are read in batches of columns, and once more where long texts are among the most
frequent values. What follows works on one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import audited_columns
from ..functions.local import local_rows
from ..operators.anomalies import MISMATCH_COUNT, anomalies_of
from ..operators.duplicates import duplicate_count, duplicate_rows
from ..operators.frequency import NO_VALUES, distinct_counts, value_summary
from ..operators.outliers import OUTLIER_FIELDS, count_outside, outlier_rows
from ..operators.profile import MISSING_PERCENTAGE, column_facts
from ..operators.quantiles import fences_by_column
from ..operators.remedies import suggest_fixes
from ..operators.reports import column_table, dataset_summary, issues, overview
from ..operators.rows import normalise_nulls
from ..operators.scoring import column_scores, dataset_score, score_bands, with_grade
from ..settings import DEFAULTS, Settings
from ..sources.scratch import checkpointed

# Columns of the enriched profile.
ENRICHED = (
    "position",
    "column",
    "dtype",
    "type_class",
    "total_rows",
    "missing_count",
    "missing_percentage",
    "unique_count",
    "min_number",
    "max_number",
    "min_text",
    "max_text",
    "mean_value",
    "std_value",
    "top_values",
    "outlier_count",
    "lower_fence",
    "upper_fence",
    "mismatch_count",
    "dataset_duplicate_count",
)


def _findings(df: DataFrame, row_id: str | None, settings: Settings, with_top_values: bool) -> DataFrame:
    """Everything the audit knows, one row per column, in column order.

    What may hold texts of any length stays with Spark, in a checkpoint of one row per column; only
    positions, counts and numeric ranges come to the driver.
    """
    df = normalise_nulls(df)
    columns = audited_columns(df, row_id)
    if with_top_values:
        # One row per column, but texts of any length: no broadcast hint.
        found = column_facts(df, columns).join(value_summary(df, row_id), "position")
    else:
        distinct = distinct_counts(df, row_id).selectExpr("position", "unique_count", f"{NO_VALUES} AS top_values")
        found = column_facts(df, columns).join(F.broadcast(distinct), "position")
    # The one count is repeated per column, so that its stages run beside all others.
    positions = f"explode(sequence(0, {max(0, len(columns) - 1)})) AS position"
    duplicates = duplicate_count(df, row_id, settings.subset).selectExpr(
        positions, "duplicate_count AS dataset_duplicate_count"
    )
    found = found.join(F.broadcast(duplicates), "position").selectExpr(
        "*", MISSING_PERCENTAGE, f"CAST(coalesce({MISMATCH_COUNT}, 0) AS BIGINT) AS mismatch_count"
    )
    # Sorted in one task: a row per column.
    found = checkpointed(found.coalesce(1).sortWithinPartitions("position"))
    names = {c.position: c.name for c in columns}
    known = found.select("position", "total_rows", "missing_count", "min_number", "max_number").collect()
    ranges = {
        names[r["position"]]: (r["total_rows"] - r["missing_count"], r["min_number"], r["max_number"]) for r in known
    }
    fences = fences_by_column(df, columns, settings.iqr_multiplier, ranges)
    counted = count_outside(df, columns, fences).collect()
    schema = T.StructType([T.StructField("position", T.IntegerType()), *OUTLIER_FIELDS])
    outliers = local_rows(df, [tuple(r[name] for name in schema.names) for r in counted], schema)
    return found.join(F.broadcast(outliers), "position")


def enriched_profile(
    df: DataFrame,
    row_id: str | None = None,
    settings: Settings = DEFAULTS,
    with_top_values: bool = True,
) -> DataFrame:
    """One row per column with everything the audit knows about it; scores and fixes read this."""
    return _findings(df, row_id, settings, with_top_values).select(*ENRICHED)


@dataclass(frozen=True)
class Audit:
    """Results of an audit. Per-column results read a row per column; row-level ones are lazy plans."""

    table: DataFrame
    row_id: str | None
    settings: Settings
    profile: DataFrame
    anomalies: DataFrame

    @property
    def scores(self) -> DataFrame:
        return column_scores(self.profile, self.settings).select("position", "column", "score").orderBy("position")

    @property
    def score(self) -> DataFrame:
        return with_grade(dataset_score(self.profile, self.settings), self.settings)

    @property
    def issues(self) -> DataFrame:
        return issues(self.profile, self.settings)

    @property
    def summary(self) -> DataFrame:
        return dataset_summary(self.profile, self.settings)

    @property
    def overview(self) -> DataFrame:
        return overview(self.profile, self.settings)

    @property
    def column_table(self) -> DataFrame:
        return column_table(self.profile, self.settings)

    @property
    def score_bands(self) -> DataFrame:
        return score_bands(self.profile, self.settings)

    @property
    def suggestions(self) -> DataFrame:
        return suggest_fixes(self.profile)

    def duplicate_rows(self) -> DataFrame:
        """Ids of repeated rows; the audit needs a row id for this."""
        return duplicate_rows(self.table, self.row_id, self.settings.subset)

    def outlier_rows(self, columns: Sequence[str] | None = None) -> DataFrame:
        """Ids and values of outliers; the audit needs a row id for this."""
        return outlier_rows(self.table, self.row_id, columns, settings=self.settings)


def audit(df: DataFrame, row_id: str | None = None, settings: Settings = DEFAULTS) -> Audit:
    """Audit a table. Persist a table that is costly to compute first: an audit reads it several times."""
    found = _findings(df, row_id, settings, with_top_values=True)
    return Audit(df, row_id, settings, found.select(*ENRICHED), anomalies_of(found))
