"""Audit and repair of tables on Spark."""

from .operators.anomalies import anomalies
from .operators.changes import change_log
from .operators.distribution import histogram, histogram_bands, outlier_bands
from .operators.duplicates import drop_duplicates, duplicate_count, duplicate_flags, duplicate_rows
from .operators.estimates import distinct_estimates, distinct_sketches, merged_sketches
from .operators.frequency import distinct_counts, top_values
from .operators.missing import missing_blocks, missing_matrix
from .operators.outliers import outlier_counts, outlier_rows
from .operators.profile import null_counts, profile
from .operators.quantiles import iqr_fences, medians, quantile_values
from .operators.remedies import Fix, apply_fixes, apply_fixes_with_log, suggest_fixes
from .operators.reports import column_table, dataset_summary, issues, overview
from .operators.rows import normalise_nulls, row_index, with_row_id
from .operators.scoring import column_scores, dataset_score, score_bands, with_grade
from .plans.audit import Audit, audit, enriched_profile
from .plans.repair import Repair, repair
from .settings import DEFAULTS, Grades, Settings, Weights
from .sources import read_csv, read_parquet, read_parquet_with_row_id, remove_scratch, staged_parquet, write_csv

__all__ = [
    "DEFAULTS",
    "Audit",
    "Fix",
    "Grades",
    "Repair",
    "Settings",
    "Weights",
    "anomalies",
    "apply_fixes",
    "apply_fixes_with_log",
    "audit",
    "change_log",
    "column_scores",
    "column_table",
    "dataset_score",
    "dataset_summary",
    "distinct_counts",
    "distinct_estimates",
    "distinct_sketches",
    "drop_duplicates",
    "duplicate_count",
    "duplicate_flags",
    "duplicate_rows",
    "enriched_profile",
    "histogram",
    "histogram_bands",
    "iqr_fences",
    "issues",
    "medians",
    "merged_sketches",
    "missing_blocks",
    "missing_matrix",
    "normalise_nulls",
    "null_counts",
    "outlier_bands",
    "outlier_counts",
    "outlier_rows",
    "overview",
    "profile",
    "quantile_values",
    "read_csv",
    "remove_scratch",
    "staged_parquet",
    "read_parquet",
    "read_parquet_with_row_id",
    "repair",
    "row_index",
    "score_bands",
    "suggest_fixes",
    "top_values",
    "with_grade",
    "with_row_id",
    "write_csv",
]
