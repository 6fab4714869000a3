"""Issues, summaries and tables for people, from the enriched profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import two_decimal_text, two_decimals
from ..functions.sqltext import array, double, struct, text
from ..settings import DEFAULTS, Settings
from .scoring import (
    DUPLICATE_PENALTY,
    DUPLICATE_PERCENT,
    IS_NUMERIC,
    column_scores,
    dataset_score,
    first_match,
    other_weights,
    share_percent,
    with_grade,
)

# Severities in order, their colours and the limits above which they apply.
SEVERITIES = ("Critical", "High", "Medium")
SEVERITY_COLOURS = {"Critical": "#E74C3C", "High": "#E67E22", "Medium": "#F1C40F"}
DUPLICATE_HIGH = 5.0
MISSING_CRITICAL, MISSING_HIGH = 30.0, 10.0
MISMATCH_HIGH = 15.0
OUTLIER_HIGH = 10.0
# Status badges.
MISSING_BADGE = "🚨 Missing"
OUTLIER_BADGE = "📊 Outliers"
MISMATCH_BADGE = "⚠️ Mismatch"
CLEAN_BADGE = "✅ Clean"
REQUIRES_FIX, CLEAN = "Requires Fix", "Clean"


def _issue(holds: str, order: int, column: str, metric: str, severity: str, impact: str, description: str) -> str:
    fields = {
        "metric_order": str(order),
        "column": column,
        "metric": text(metric),
        "severity": severity,
        "score_impact": two_decimals(impact),
        "description": description,
    }
    return f"CASE WHEN {holds} THEN {struct(fields)} END"


def _severity(percent: str, high: float, critical: float | None = None) -> str:
    cases = [] if critical is None else [(f"{percent} > {double(critical)}", text("Critical"))]
    return first_match([*cases, (f"{percent} > {double(high)}", text("High"))], text("Medium"))


def issues(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Quality issues, worst first. ``score_impact`` is the weighted percentage, not the loss of score."""
    w = settings.weights
    other_completeness, _, other_consistency = other_weights(settings)
    mismatches, outliers = share_percent("mismatch_count"), share_percent("outlier_count")

    def weight(numeric: float, other: float) -> str:
        return f"CASE WHEN {IS_NUMERIC} THEN {double(numeric)} ELSE {double(other)} END"

    figures = enriched.selectExpr(
        "*", f"{DUPLICATE_PERCENT} AS duplicates", f"{mismatches} AS mismatches", f"{outliers} AS outliers"
    )
    found = [
        _issue(
            "position = 0 AND dataset_duplicate_count > 0",
            0,
            text("Dataset"),
            "Duplicates",
            _severity("duplicates", DUPLICATE_HIGH),
            DUPLICATE_PENALTY,
            f"concat('Dataset contains ', dataset_duplicate_count, ' duplicate rows (', {two_decimal_text('duplicates')}, '% of total).')",
        ),
        _issue(
            "missing_percentage > 0",
            1,
            "column",
            "Completeness",
            _severity("missing_percentage", MISSING_HIGH, MISSING_CRITICAL),
            f"missing_percentage * {weight(w.completeness, other_completeness)}",
            f"concat('Column contains ', {two_decimal_text('missing_percentage')}, '% missing values.')",
        ),
        _issue(
            "mismatch_count > 0",
            2,
            "column",
            "Type Consistency",
            _severity("mismatches", MISMATCH_HIGH),
            f"mismatches * {weight(w.consistency, other_consistency)}",
            "concat('Detected ', mismatch_count, ' structural type anomalies in column values.')",
        ),
        _issue(
            f"outlier_count > 0 AND {IS_NUMERIC}",
            3,
            "column",
            "Outlier Rate",
            _severity("outliers", OUTLIER_HIGH),
            f"outliers * {double(w.outlier)}",
            "concat('Detected ', outlier_count, ' statistical anomalies outside IQR thresholds.')",
        ),
    ]
    severities = array([text(s) for s in SEVERITIES])
    colours = ", ".join(text(x) for pair in SEVERITY_COLOURS.items() for x in pair)
    # The dataset issue comes before the issues of any column. At most four rows per column are ranked.
    order = f"array_position({severities}, severity), score_impact DESC, metric_order != 0, position, metric_order"
    return (
        figures.selectExpr("position", f"inline(array_compact({array(found)}))")
        .selectExpr(
            f"row_number() OVER (ORDER BY {order}) AS rank",
            "column",
            "metric",
            "severity",
            "score_impact",
            "description",
            f"element_at(map({colours}), severity) AS severity_color",
        )
        .orderBy("rank")
    )


def dataset_summary(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: score, grade, colour and the ranked issues as an array."""
    ranked = issues(enriched, settings).agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "column", "metric", "severity", "score_impact", "description"))
        ).alias("issues")
    )
    score = with_grade(dataset_score(enriched, settings), settings)
    return score.select(
        F.col("score").alias("overall_score"),
        F.col("grade").alias("category"),
        "color_hex",
        ranked.scalar().alias("issues"),
    )


def overview(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: score, grade, size of the table, number of issues and whether it needs a fix."""
    size = enriched.agg(
        F.coalesce(F.max("total_rows"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("column_count")
    )
    score = with_grade(dataset_score(enriched, settings), settings)
    issue_count = issues(enriched, settings).agg(F.count(F.lit(1)).alias("n"))
    return (
        score.select("score", "grade")
        .withColumn("total_rows", size.select("total_rows").scalar())
        .withColumn("column_count", size.select("column_count").scalar())
        .withColumn("issue_count", issue_count.scalar())
        .withColumn("state", F.when(F.col("issue_count") > 0, REQUIRES_FIX).otherwise(CLEAN))
    )


def column_table(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Columns from the lowest score up, with counts and status badges."""
    badges = (
        f"concat_ws(', ', CASE WHEN missing_count > 0 THEN {text(MISSING_BADGE)} END, "
        f"CASE WHEN outlier_count > 0 THEN {text(OUTLIER_BADGE)} END, "
        f"CASE WHEN mismatch_count > 0 THEN {text(MISMATCH_BADGE)} END)"
    )
    scores = column_scores(enriched, settings).select("position", "score")
    # Both sides hold one row per column of the table.
    return (
        enriched.join(F.broadcast(scores), "position")
        .selectExpr(
            "position",
            "column",
            "dtype AS type",
            "score",
            "missing_count AS missing",
            "outlier_count AS outliers",
            f"coalesce(nullif({badges}, ''), {text(CLEAN_BADGE)}) AS status",
        )
        .orderBy("score", "position")
    )
