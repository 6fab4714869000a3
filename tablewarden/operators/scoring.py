"""Scores and grades from the enriched profile (one row per column of the audited table)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC
from ..functions.numbers import whole_score
from ..functions.sqltext import double, text
from ..settings import DEFAULTS, Settings

# Uniqueness scores by the share of distinct values.
# Numeric columns take the first limit the share is under, other columns the first it exceeds.
NUMERIC_UNIQUENESS = ((0.05, 20.0), (0.20, 60.0))
NUMERIC_UNIQUENESS_ELSE = 85.0
OTHER_UNIQUENESS = ((0.95, 65.0), (0.60, 80.0), (0.05, 90.0), (0.01, 60.0))
OTHER_UNIQUENESS_ELSE = 20.0
# Score points lost per percent, and the duplicate penalty.
MISMATCH_FACTOR = 2.5
OUTLIER_FACTOR = 3.0
DUPLICATE_FACTOR = 0.5
LARGEST_PENALTY = 20.0
# Grades with their colours, best first, and the colour bands of score bars.
GRADE_COLOURS = {
    "Excellent": "#2ECC71",
    "Good": "#3498DB",
    "Fair": "#F1C40F",
    "Poor": "#E67E22",
    "Critical": "#E74C3C",
}
SCORE_BANDS = ((90, "#2ECC71"), (70, "#3498DB"), (50, "#F1C40F"), (30, "#E67E22"))
LOWEST_BAND = "#E74C3C"


IS_NUMERIC = f"type_class = '{NUMERIC}'"


def share_percent(count: str) -> str:
    """Percentage of the rows; an empty table counts as one row, so shares stay defined."""
    return f"(CAST({count} AS DOUBLE) / CAST(greatest(total_rows, 1) AS DOUBLE) * 100.0D)"


DUPLICATE_PERCENT = share_percent("dataset_duplicate_count")
DUPLICATE_PENALTY = f"least({double(LARGEST_PENALTY)}, {DUPLICATE_PERCENT} * {double(DUPLICATE_FACTOR)})"


def other_weights(settings: Settings) -> tuple[float, float, float]:
    """Weights of columns without an outlier factor, scaled to sum to one."""
    w = settings.weights
    total = w.completeness + w.uniqueness + w.consistency or 1.0
    return w.completeness / total, w.uniqueness / total, w.consistency / total


def first_match(cases: Iterable[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {result}" for condition, result in cases) + f" ELSE {otherwise} END"


def _weighted(weights: Iterable[float]) -> str:
    # The order of the sum matters: raw scores can sit exactly on a half.
    factors = ("completeness", "uniqueness", "consistency", "outlier")
    return " + ".join(f"{double(weight)} * {factor}" for weight, factor in zip(weights, factors, strict=False))


def column_scores(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Factor scores, weighted raw score and whole score per column."""
    w = settings.weights
    numeric = first_match(
        [(f"share < {double(limit)}", double(score)) for limit, score in NUMERIC_UNIQUENESS], double(NUMERIC_UNIQUENESS_ELSE)
    )
    other = first_match(
        [(f"share > {double(limit)}", double(score)) for limit, score in OTHER_UNIQUENESS], double(OTHER_UNIQUENESS_ELSE)
    )
    shares = enriched.selectExpr(
        "*", "CAST(coalesce(unique_count, 0) AS DOUBLE) / CAST(greatest(total_rows, 1) AS DOUBLE) AS share"
    )
    factors = shares.selectExpr(
        "position",
        "column",
        "type_class",
        f"greatest(0.0D, 100.0D - {share_percent('missing_count')}) AS completeness",
        f"CASE WHEN {IS_NUMERIC} THEN {numeric} ELSE {other} END AS uniqueness",
        f"greatest(0.0D, 100.0D - {share_percent('mismatch_count')} * {double(MISMATCH_FACTOR)}) AS consistency",
        f"CASE WHEN {IS_NUMERIC} THEN greatest(0.0D, 100.0D - {share_percent('outlier_count')} * {double(OUTLIER_FACTOR)}) END AS outlier",
    )
    four = _weighted((w.completeness, w.uniqueness, w.consistency, w.outlier))
    raw = f"CASE WHEN {IS_NUMERIC} THEN {four} ELSE {_weighted(other_weights(settings))} END AS raw_score"
    columns = ("position", "column", "completeness", "uniqueness", "consistency", "outlier")
    return factors.selectExpr(*columns, raw).selectExpr("*", f"{whole_score('raw_score')} AS score")


def dataset_score(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: mean of the column scores less the duplicate penalty; 0 for a table without columns."""
    mean = column_scores(enriched, settings).agg(F.avg("score").alias("mean_score"))
    penalty = enriched.agg(F.expr(f"max({DUPLICATE_PENALTY})"))
    return mean.withColumn("duplicate_penalty", penalty.scalar()).selectExpr(
        "mean_score",
        "duplicate_penalty",
        f"coalesce({whole_score('greatest(0.0D, mean_score - duplicate_penalty)')}, 0) AS score",
    )


def with_grade(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Scores with their grade and its colour."""
    g = settings.grades
    limits = {"Excellent": g.excellent, "Good": g.good, "Fair": g.fair, "Poor": g.poor}
    grade = first_match([(f"score >= {limit}", text(name)) for name, limit in limits.items()], text("Critical"))
    colours = ", ".join(text(x) for pair in GRADE_COLOURS.items() for x in pair)
    return scores.selectExpr("*", f"{grade} AS grade").selectExpr("*", f"element_at(map({colours}), grade) AS color_hex")


def score_bands(enriched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Column scores from low to high with the colour of their band."""
    colour = first_match([(f"score >= {limit}", text(c)) for limit, c in SCORE_BANDS], text(LOWEST_BAND))
    return (
        column_scores(enriched, settings)
        .selectExpr("position", "column", "score", f"{colour} AS color_hex")
        .orderBy("score", "position")
    )
