"""SQL for DuckDB that states the expected result of each registered query."""

from __future__ import annotations

from .views import (
    CONVERSATIONS,
    CUSTOMERS,
    DOCUMENTS,
    EMBEDDINGS,
    EVENTS,
    EXACT_KEYS,
    KEYS,
    LABELS,
    LINEITEM,
    ORDERS,
    ORPHANED_ORDERS,
    PAGES,
    PART,
    Audited,
)

EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def with_base(table: Audited, rest: str) -> str:
    return f"WITH base AS ({table.duckdb()}) {rest}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def names(table: Audited) -> list[str]:
    return [c for c, _, _ in table.columns]


def nearest(c: str, q: float) -> str:
    values = f"list_sort(list(CAST({c} AS DOUBLE)) FILTER (WHERE {c} IS NOT NULL))"
    return f"{values}[CAST(floor((count({c}) - 1) * {q} + 0.5) AS BIGINT) + 1]"


def duplicates(keys: list[str]) -> str:
    """Scalar subquery: rows beyond the first of each group."""
    return (
        f"(SELECT (SELECT count(*) FROM base) - count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM base) g)"
    )


def mixed(c: str) -> str:
    return f"count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NOT NULL)"


def bad_email(c: str) -> str:
    return f"count(*) FILTER (WHERE NOT regexp_full_match({c}, '{EMAIL}'))"


def bad_date(c: str) -> str:
    return (
        f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DATE) IS NULL "
        f"AND TRY_CAST({c} AS TIMESTAMP) IS NULL)"
    )


def mismatch(c: str, kind: str) -> str:
    if kind != "string":
        return "0"
    parts = [f"CASE WHEN {mixed(c)} BETWEEN 1 AND count({c}) - 1 THEN {mixed(c)} ELSE 0 END"]
    if "email" in c.lower():
        parts.append(bad_email(c))
    if "date" in c.lower():
        parts.append(bad_date(c))
    return f"least(count(*), {' + '.join(parts)})"


def fences(table: Audited, multiplier: float = 1.5) -> str:
    """position, column, q25, q75, lower_fence, upper_fence for every column."""
    parts = []
    for i, (c, _, kind) in enumerate(table.columns):
        if kind == "numeric":
            parts.append(
                f"SELECT {i} AS position, '{c}' AS \"column\", {nearest(c, 0.25)} AS q25, {nearest(c, 0.75)} AS q75 FROM base"
            )
        else:
            parts.append(
                f"SELECT {i} AS position, '{c}' AS \"column\", CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q75"
            )
    return (
        'SELECT position, "column", q25, q75, '
        f"coalesce(q25 - {multiplier} * (q75 - q25), 0.0) AS lower_fence, "
        f"coalesce(q75 + {multiplier} * (q75 - q25), 0.0) AS upper_fence FROM ({union(parts)}) q"
    )


def hub(table: Audited, subset: list[str] | None = None, multiplier: float = 1.5) -> str:
    """CTEs that end in ``hub``: one row per column."""
    facts = []
    for i, (c, dtype, kind) in enumerate(table.columns):
        outliers = (
            f"(SELECT count(*) FROM base b WHERE b.{c} < f.lower_fence OR b.{c} > f.upper_fence)"
            if kind == "numeric"
            else "0"
        )
        facts.append(
            f"SELECT f.position, f.\"column\", '{dtype}' AS dtype, '{kind}' AS type_class, a.total_rows, a.missing_count, "
            "CASE WHEN a.total_rows > 0 THEN a.missing_count / a.total_rows * 100.0 ELSE 0.0 END AS missing_percentage, "
            f"a.unique_count, CAST({outliers} AS BIGINT) AS outlier_count, f.lower_fence, f.upper_fence, "
            "a.mismatch_count, d.n AS dataset_duplicate_count "
            f"FROM (SELECT count(*) AS total_rows, count(*) - count({c}) AS missing_count, "
            f"count(DISTINCT {c}) AS unique_count, CAST({mismatch(c, kind)} AS BIGINT) AS mismatch_count FROM base) a, "
            f"(SELECT * FROM fences WHERE position = {i}) f, dup d"
        )
    return (
        f"WITH base AS ({table.duckdb()}), fences AS ({fences(table, multiplier)}), "
        f"dup AS (SELECT CAST({duplicates(subset or names(table))} AS BIGINT) AS n), hub AS ({union(facts)})"
    )


SCORED = """
scored AS (
  SELECT position, "column", completeness, uniqueness, consistency, outlier, raw_score,
         CAST(least(100, greatest(0, round_even(raw_score, 0))) AS INTEGER) AS score
  FROM (
    SELECT *, CASE WHEN type_class = 'numeric'
                THEN CAST(0.4 AS DOUBLE) * completeness + CAST(0.2 AS DOUBLE) * uniqueness
                   + CAST(0.2 AS DOUBLE) * consistency + CAST(0.2 AS DOUBLE) * outlier
                ELSE CAST(0.5 AS DOUBLE) * completeness + CAST(0.25 AS DOUBLE) * uniqueness
                   + CAST(0.25 AS DOUBLE) * consistency END AS raw_score
    FROM (
      SELECT position, "column", type_class,
             greatest(0.0, 100.0 - missing_count / total_rows * 100.0) AS completeness,
             CAST(CASE WHEN type_class = 'numeric'
                    THEN CASE WHEN unique_count / total_rows < 0.05 THEN 20 WHEN unique_count / total_rows < 0.2 THEN 60 ELSE 85 END
                    ELSE CASE WHEN unique_count / total_rows > 0.95 THEN 65 WHEN unique_count / total_rows > 0.6 THEN 80
                              WHEN unique_count / total_rows > 0.05 THEN 90 WHEN unique_count / total_rows > 0.01 THEN 60 ELSE 20 END
                  END AS DOUBLE) AS uniqueness,
             greatest(0.0, 100.0 - mismatch_count / total_rows * 100.0 * CAST(2.5 AS DOUBLE)) AS consistency,
             CASE WHEN type_class = 'numeric'
                  THEN greatest(0.0, 100.0 - outlier_count / total_rows * 100.0 * CAST(3.0 AS DOUBLE)) END AS outlier
      FROM hub) factors) weighted),
penalty AS (SELECT least(20.0, max(dataset_duplicate_count / total_rows * 100.0) * CAST(0.5 AS DOUBLE)) AS p FROM hub),
total AS (
  SELECT avg(score) AS mean_score, max(p) AS duplicate_penalty,
         CAST(least(100, greatest(0, round_even(greatest(0.0, avg(score) - max(p)), 0))) AS INTEGER) AS score
  FROM scored, penalty)
"""

GRADE = (
    "CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' "
    "WHEN score >= 30 THEN 'Poor' ELSE 'Critical' END"
)
GRADE_COLOUR = (
    "CASE WHEN score >= 85 THEN '#2ECC71' WHEN score >= 70 THEN '#3498DB' WHEN score >= 50 THEN '#F1C40F' "
    "WHEN score >= 30 THEN '#E67E22' ELSE '#E74C3C' END"
)

ISSUES = """
found AS (
  SELECT -1 AS position, 0 AS metric_order, 'Dataset' AS "column", 'Duplicates' AS metric,
         CASE WHEN pct > 5 THEN 'High' ELSE 'Medium' END AS severity, least(20.0, pct * CAST(0.5 AS DOUBLE)) AS impact,
         concat('Dataset contains ', n, ' duplicate rows (', printf('%.2f', pct), '% of total).') AS description
  FROM (SELECT max(dataset_duplicate_count) AS n, max(dataset_duplicate_count / total_rows * 100.0) AS pct FROM hub) d
  WHERE n > 0
  UNION ALL
  SELECT position, 1, "column", 'Completeness',
         CASE WHEN missing_percentage > 30 THEN 'Critical' WHEN missing_percentage > 10 THEN 'High' ELSE 'Medium' END,
         missing_percentage * CASE WHEN type_class = 'numeric' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END,
         concat('Column contains ', printf('%.2f', missing_percentage), '% missing values.')
  FROM hub WHERE missing_percentage > 0
  UNION ALL
  SELECT position, 2, "column", 'Type Consistency',
         CASE WHEN mismatch_count / total_rows * 100.0 > 15 THEN 'High' ELSE 'Medium' END,
         mismatch_count / total_rows * 100.0 * CASE WHEN type_class = 'numeric' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END,
         concat('Detected ', mismatch_count, ' structural type anomalies in column values.')
  FROM hub WHERE mismatch_count > 0
  UNION ALL
  SELECT position, 3, "column", 'Outlier Rate',
         CASE WHEN outlier_count / total_rows * 100.0 > 10 THEN 'High' ELSE 'Medium' END,
         outlier_count / total_rows * 100.0 * CAST(0.2 AS DOUBLE),
         concat('Detected ', outlier_count, ' statistical anomalies outside IQR thresholds.')
  FROM hub WHERE outlier_count > 0 AND type_class = 'numeric'),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 ELSE 2 END,
                            score_impact DESC, position, metric_order) AS INTEGER) AS rank,
         "column", metric, severity, score_impact, description,
         CASE severity WHEN 'Critical' THEN '#E74C3C' WHEN 'High' THEN '#E67E22' ELSE '#F1C40F' END AS severity_color
  FROM (SELECT *, round_even(impact * 100.0, 0) / 100.0 AS score_impact FROM found) f)
"""

SUGGESTIONS = """
SELECT 0 AS position, 0 AS action_order, 'All Columns' AS "column", 'DROP_DUPLICATES' AS action_type,
       concat('Purge ', max(dataset_duplicate_count), ' structural multi-row duplicate occurrences across full table index context.') AS description,
       'High' AS estimated_impact, CAST(NULL AS VARCHAR) AS dtype, CAST(NULL AS DOUBLE) AS lower_fence, CAST(NULL AS DOUBLE) AS upper_fence
FROM hub HAVING max(dataset_duplicate_count) > 0
UNION ALL
SELECT position, 1, "column", 'FILL_MISSING',
       concat('Impute ', missing_count, ' blank missing fields using statistical central tendency configurations.'),
       'Medium', dtype, NULL, NULL
FROM hub WHERE missing_count > 0 AND type_class <> 'temporal'
UNION ALL
SELECT position, 2, "column", 'CAP_OUTLIERS',
       concat('Clamp ', outlier_count, ' variance outliers safely inside calculated IQR constraints boundaries.'),
       'Medium', NULL, lower_fence, upper_fence
FROM hub WHERE outlier_count > 0
"""


def enriched(table: Audited) -> str:
    return (
        f'{hub(table)} SELECT position, "column", dtype, type_class, total_rows, missing_count, missing_percentage, '
        "unique_count, outlier_count, lower_fence, upper_fence, mismatch_count, dataset_duplicate_count FROM hub"
    )


def scores(table: Audited) -> str:
    return f"{hub(table)}, {SCORED} SELECT * FROM scored"


def dataset_score(table: Audited, subset: list[str] | None = None) -> str:
    return f"{hub(table, subset)}, {SCORED} SELECT mean_score, duplicate_penalty, score FROM total"


def grades(table: Audited) -> str:
    return f'{hub(table)}, {SCORED} SELECT "column", score, {GRADE} AS grade, {GRADE_COLOUR} AS color_hex FROM scored'


def score_bands(table: Audited) -> str:
    colour = (
        "CASE WHEN score >= 90 THEN '#2ECC71' WHEN score >= 70 THEN '#3498DB' WHEN score >= 50 THEN '#F1C40F' "
        "WHEN score >= 30 THEN '#E67E22' ELSE '#E74C3C' END"
    )
    return f'{hub(table)}, {SCORED} SELECT position, "column", score, {colour} AS color_hex FROM scored'


def issues(table: Audited) -> str:
    return f"{hub(table)}, {ISSUES} SELECT * FROM ranked"


def summary(table: Audited) -> str:
    return (
        f"{hub(table)}, {SCORED}, {ISSUES} SELECT score AS overall_score, {GRADE} AS category, {GRADE_COLOUR} AS color_hex, "
        "(SELECT string_agg(concat_ws(' / ', \"column\", metric, severity, score_impact, description), '; ' ORDER BY rank) FROM ranked) AS issues FROM total"
    )


def overview(table: Audited) -> str:
    return (
        f"{hub(table)}, {SCORED}, {ISSUES} SELECT score, {GRADE} AS grade, (SELECT max(total_rows) FROM hub) AS total_rows, "
        "(SELECT count(*) FROM hub) AS column_count, (SELECT count(*) FROM ranked) AS issue_count, "
        "CASE WHEN (SELECT count(*) FROM ranked) > 0 THEN 'Requires Fix' ELSE 'Clean' END AS state FROM total"
    )


def column_table(table: Audited) -> str:
    return (
        f'{hub(table)}, {SCORED} SELECT h.position, h."column", h.dtype AS type, s.score, h.missing_count AS missing, '
        "h.outlier_count AS outliers, CASE WHEN missing_count = 0 AND outlier_count = 0 AND mismatch_count = 0 THEN '✅ Clean' "
        "ELSE concat_ws(', ', CASE WHEN missing_count > 0 THEN '🚨 Missing' END, CASE WHEN outlier_count > 0 THEN '📊 Outliers' END, "
        "CASE WHEN mismatch_count > 0 THEN '⚠️ Mismatch' END) END AS status FROM hub h JOIN scored s USING (position)"
    )


def suggestions(table: Audited) -> str:
    return f"{hub(table)} {SUGGESTIONS}"


def null_counts(table: Audited) -> str:
    return with_base(
        table,
        union(
            [
                f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS missing_count, "
                f"(count(*) - count({c})) / count(*) * 100.0 AS missing_percentage FROM base"
                for i, c in enumerate(names(table))
            ]
        ),
    )


def distinct_counts(table: Audited) -> str:
    return with_base(
        table,
        union(
            [
                f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM base"
                for i, c in enumerate(names(table))
            ]
        ),
    )


def profile_numeric(table: Audited) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS missing_count, "
        f"count(DISTINCT {c}) AS unique_count, CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number, "
        f"round(avg(CAST({c} AS DOUBLE)), 4) AS mean_value, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std_value FROM base"
        for c in table.numeric()
    ]
    return with_base(table, union(parts))


def profile_texts(table: Audited) -> str:
    parts = []
    for c, _, kind in table.columns:
        if kind == "numeric":
            continue
        low, high = f"min({c})", f"max({c})"
        if kind == "temporal":
            # Drop the zeros at the end of the fraction, as Spark prints timestamps.
            low, high = (
                f"regexp_replace(regexp_replace(strftime({x}, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '')"
                for x in (low, high)
            )
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS missing_count, "
            f"count(DISTINCT {c}) AS unique_count, CAST({low} AS VARCHAR) AS min_text, CAST({high} AS VARCHAR) AS max_text FROM base"
        )
    return with_base(table, union(parts))


def top_values(table: Audited, only: list[str] | None = None) -> str:
    """Equal counts order by the plain value."""
    parts = []
    for c, _, _ in table.columns:
        if only is not None and c not in only:
            continue
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY n DESC, k) AS INTEGER) AS rank, value, n AS \"count\" "
            f"FROM (SELECT {c} AS k, CAST(any_value({c}) AS VARCHAR) AS value, count(*) AS n FROM base "
            f"WHERE {c} IS NOT NULL GROUP BY {c}) g"
        )
    return with_base(table, f"SELECT * FROM ({union(parts)}) t WHERE rank <= 5")


def audit_values(table: Audited) -> str:
    """Ranges, moments and most frequent values of every column."""
    parts = []
    for i, (c, _, kind) in enumerate(table.columns):
        numbers = ["CAST(NULL AS DOUBLE)"] * 4
        texts = ["CAST(NULL AS VARCHAR)"] * 2
        if kind == "numeric":
            x = f"CAST({c} AS DOUBLE)"
            numbers = [f"min({x})", f"max({x})", f"round(avg({x}), 4)", f"round(stddev_samp({x}), 4)"]
        else:
            texts = [shown(f"min({c})", kind), shown(f"max({c})", kind)]
        best = (
            f"SELECT {shown(c, kind)} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place "
            f"FROM base WHERE {c} IS NOT NULL GROUP BY {c}"
        )
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {numbers[0]} AS min_number, {numbers[1]} AS max_number, "
            f"{texts[0]} AS min_text, {texts[1]} AS max_text, {numbers[2]} AS mean_value, {numbers[3]} AS std_value, "
            f"coalesce((SELECT string_agg(concat(value, '=', n), '|' ORDER BY place) FROM ({best}) b WHERE place <= 5), '') AS top_values FROM base"
        )
    return with_base(table, union(parts))


def shown(value: str, kind: str) -> str:
    """A value as Spark prints it; timestamps without the zeros at the end of the fraction."""
    if kind != "temporal":
        return f"CAST({value} AS VARCHAR)"
    return f"regexp_replace(regexp_replace(strftime({value}, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '')"


def iqr_fences(table: Audited, multiplier: float = 1.5) -> str:
    return with_base(table, fences(table, multiplier))


def medians(table: Audited) -> str:
    return with_base(
        table,
        union(
            [
                f"SELECT '{c}' AS \"column\", CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) AS median FROM base"
                for c in table.numeric()
            ]
        ),
    )


def middle_two(c: str, result: str) -> str:
    """A scalar of the two middle values ``a`` and ``b`` of a column."""
    ranked = f"SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM base WHERE {c} IS NOT NULL"
    return f"(SELECT {result} FROM (SELECT min(v) AS a, max(v) AS b FROM ({ranked}) x WHERE r IN ((n - 1) // 2, n // 2)) y)"


def value_at(c: str, quantile: float) -> str:
    """The value of a column at a nearest rank, in its own type."""
    ranked = f"SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM base WHERE {c} IS NOT NULL"
    return f"(SELECT v FROM ({ranked}) x WHERE r = CAST(floor((n - 1) * {quantile} + 0.5) AS BIGINT))"


def quantile_values(table: Audited, names: tuple[str, ...], quantiles: tuple[float, ...]) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS quantile, CAST({value_at(c, q)} AS VARCHAR) AS value" for c in names for q in quantiles
    ]
    return with_base(table, union(parts))


def large_fences(table: Audited, c: str) -> str:
    """Fences of a bigint column in whole numbers, each rounded to a double once."""
    q25, q75 = (f"CAST({value_at(c, q)} AS HUGEINT)" for q in (0.25, 0.75))
    lower, upper = "CAST(2 * q25 - 3 * (q75 - q25) AS DOUBLE) / 2", "CAST(2 * q75 + 3 * (q75 - q25) AS DOUBLE) / 2"
    return with_base(
        table,
        f"SELECT '{c}' AS \"column\", CAST(q25 AS DOUBLE) AS q25, CAST(q75 AS DOUBLE) AS q75, {lower} AS lower_fence, {upper} AS upper_fence "
        f"FROM (SELECT {q25} AS q25, {q75} AS q75) q",
    )


def large_medians(table: Audited) -> str:
    exact = middle_two("big_key", "CAST(CAST(a AS HUGEINT) + b AS DOUBLE) / 2")
    plain = [f"SELECT '{c}' AS \"column\", CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) AS median FROM base" for c in ("price", "o_custkey")]
    return with_base(table, union([f"SELECT 'big_key' AS \"column\", {exact} AS median", *plain]))


def outlier_counts(table: Audited, multiplier: float = 1.5) -> str:
    return (
        f'{hub(table, multiplier=multiplier)} SELECT position, "column", outlier_count, lower_fence, upper_fence FROM hub'
    )


def outlier_rows(table: Audited, only: list[str] | None = None, multiplier: float = 1.5) -> str:
    parts = [
        f"SELECT b.{table.row_id}, '{c}' AS \"column\", CAST(b.{c} AS DOUBLE) AS value FROM base b, "
        f"(SELECT * FROM fences WHERE \"column\" = '{c}') f WHERE b.{c} < f.lower_fence OR b.{c} > f.upper_fence"
        for c in (only or table.numeric())
    ]
    return f"WITH base AS ({table.duckdb()}), fences AS ({fences(table, multiplier)}) {union(parts)}"


def histogram_cells(table: Audited) -> list[str]:
    return [
        f"SELECT '{c}' AS \"column\", v, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) / ((hi - lo) / 40)), 39) AS INTEGER) ELSE 0 END AS bin, "
        f"lo, CASE WHEN hi > lo THEN (hi - lo) / 40 ELSE 0 END AS width FROM (SELECT CAST({c} AS DOUBLE) AS v FROM base WHERE {c} IS NOT NULL) b, "
        f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM base) r"
        for c in table.numeric()
    ]


def histogram(table: Audited) -> str:
    return with_base(
        table,
        'SELECT "column", bin, max(lo + bin * width) AS bin_start, max(lo + (bin + 1) * width) AS bin_end, '
        f'count(*) AS "count" FROM ({union(histogram_cells(table))}) c GROUP BY "column", bin',
    )


def histogram_bands(table: Audited) -> str:
    return (
        f"WITH base AS ({table.duckdb()}), fences AS ({fences(table)}) "
        "SELECT c.\"column\", c.bin, CASE WHEN v < lower_fence THEN 'lower' WHEN v > upper_fence THEN 'upper' ELSE 'inlier' END AS band, "
        f'count(*) AS "count" FROM ({union(histogram_cells(table))}) c JOIN fences f ON f."column" = c."column" '
        "GROUP BY ALL"
    )


def outlier_bands(table: Audited) -> str:
    parts = []
    for c in table.numeric():
        ranges = f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM base) r, (SELECT * FROM fences WHERE \"column\" = '{c}') f"
        parts.append(
            f"SELECT '{c}' AS \"column\", 'lower' AS band, lo AS band_start, lower_fence AS band_end FROM {ranges} WHERE lo < lower_fence"
        )
        parts.append(f"SELECT '{c}', 'upper', upper_fence, hi FROM {ranges} WHERE hi > upper_fence")
    return f"WITH base AS ({table.duckdb()}), fences AS ({fences(table)}) {union(parts)}"


def duplicate_count(table: Audited, keys: list[str] | None = None) -> str:
    return with_base(table, f"SELECT CAST({duplicates(keys or names(table))} AS BIGINT) AS duplicate_count")


def numbered(table: Audited, keys: list[str]) -> str:
    return (
        f"SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {table.row_id}) AS occurrence FROM base"
    )


def duplicate_rows(table: Audited, keys: list[str] | None = None) -> str:
    found = numbered(table, keys or names(table))
    return with_base(table, f"SELECT {table.row_id} FROM ({found}) n WHERE occurrence > 1")


def duplicate_flags(table: Audited, shown: list[str]) -> str:
    found = numbered(table, names(table))
    return with_base(
        table,
        f"SELECT {', '.join([table.row_id, *shown])}, CASE WHEN occurrence > 1 THEN 'Duplicate Footprint' "
        f"ELSE 'Normal Record' END AS is_duplicate FROM ({found}) n",
    )


def drop_duplicates(table: Audited, shown: list[str], keys: list[str] | None = None) -> str:
    found = numbered(table, keys or names(table))
    return with_base(table, f"SELECT {', '.join(shown)} FROM ({found}) n WHERE occurrence = 1")


def anomalies(table: Audited, kind: str) -> str:
    parts = []
    for c, _, k in table.columns:
        filled = f"count({c})"
        if kind == "null_column":
            n, holds, text = "count(*)", f"count(*) > 0 AND {filled} = 0", "NULL"
        elif kind == "zero_column":
            if k != "numeric":
                continue
            n, holds, text = filled, f"{filled} > 0 AND count(*) FILTER (WHERE {c} = 0) = {filled}", "NULL"
        elif k != "string":
            continue
        elif kind == "mixed_numeric":
            n = mixed(c)
            holds, text = f"{n} > 0 AND {n} < {filled}", "'Mixed numeric and text patterns detected'"
        elif kind == "malformed_email":
            if "email" not in c.lower():
                continue
            n = bad_email(c)
            holds, text = f"{n} > 0", "'Malformed structural email patterns'"
        else:
            if "date" not in c.lower():
                continue
            n = bad_date(c)
            holds, text = f"{n} > 0", "'Multi-format timeline sequences or corrupted string literals'"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS kind, CAST({text} AS VARCHAR) AS issue, {n} AS affected_rows FROM base HAVING {holds}"
        )
    return with_base(table, union(parts))


def missing_matrix(table: Audited) -> str:
    flags = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}" for c in names(table))
    return with_base(table, f"SELECT {table.row_id}, {flags} FROM base")


def missing_blocks(table: Audited, block: int) -> str:
    sums = ", ".join(f"count(*) - count({c}) AS {c}" for c in names(table))
    return with_base(
        table,
        f"SELECT CAST(floor({table.row_id} / {block}) AS BIGINT) AS row_block, count(*) AS block_rows, {sums} FROM base GROUP BY 1",
    )


def kept_rows(table: Audited, keys: list[str] | None = None) -> str:
    found = numbered(table, keys or names(table))
    return f"base AS ({table.duckdb()}), kept AS (SELECT * EXCLUDE (occurrence) FROM ({found}) n WHERE occurrence = 1)"


# Whole-number columns with missing values; the others have no finding and keep their type.
FILLED_INTEGERS = ("nation_key",)


def repaired(table: Audited, keys: list[str] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """CTEs up to ``joined`` (kept rows with fences and medians) and (column, old, new) expressions."""
    medians_sql = ", ".join(
        f"(SELECT CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) FROM kept) AS med_{c}" for c in table.numeric()
    )
    fences_sql = ", ".join(
        f"(SELECT lower_fence FROM fences WHERE \"column\" = '{c}') AS lo_{c}, (SELECT upper_fence FROM fences WHERE \"column\" = '{c}') AS hi_{c}"
        for c in table.numeric()
    )
    ctes = (
        f"WITH {kept_rows(table, keys)}, fences AS ({fences(table)}), "
        f"params AS (SELECT {medians_sql}, {fences_sql}), joined AS (SELECT * FROM kept, params)"
    )
    new = []
    for c, dtype, kind in table.columns:
        if dtype in ("int", "bigint") and c not in FILLED_INTEGERS:
            new.append((c, c, c))
        elif kind == "numeric":
            value = f"coalesce(CAST({c} AS DOUBLE), med_{c}, 0.0)"
            new.append((c, c, f"CASE WHEN {value} < lo_{c} THEN lo_{c} WHEN {value} > hi_{c} THEN hi_{c} ELSE {value} END"))
        elif kind == "boolean":
            new.append((c, c, f"coalesce({c}, FALSE)"))
        elif kind == "string":
            new.append((c, c, f"coalesce({c}, 'Unknown')"))
        else:
            new.append((c, c, c))
    return ctes, new


def clean_all(table: Audited, keys: list[str] | None = None) -> str:
    """Columns without a finding keep their values: they lie inside their fences and hold no nulls."""
    ctes, new = repaired(table, keys)
    return f"{ctes} SELECT {table.row_id}, {', '.join(f'{n} AS {c}' for c, _, n in new)} FROM joined"


def change_log(table: Audited, keys: list[str] | None = None) -> str:
    ctes, new = repaired(table, keys)
    parts = [
        f"SELECT {i} AS position, '{c}' AS \"column\", "
        f"count(*) FILTER (WHERE {old} IS NULL AND {n} IS NOT NULL) AS filled, "
        f"count(*) FILTER (WHERE {old} IS NOT NULL AND {n} IS NOT NULL AND {old} <> {n}) AS modified, "
        f"count(*) FILTER (WHERE {old} IS NOT NULL AND {n} IS NULL) AS nullified, "
        f"count(*) FILTER (WHERE {old} IS DISTINCT FROM {n}) AS mutations, "
        "CAST((SELECT count(*) FROM base) - count(*) AS BIGINT) AS rows_dropped FROM joined"
        for i, (c, old, n) in enumerate(new)
    ]
    return f"{ctes} {union(parts)}"


def fill(table: Audited, c: str, value: str) -> str:
    return with_base(table, f"SELECT * REPLACE (coalesce({c}, {value}) AS {c}) FROM base")


def clamp(table: Audited, c: str) -> str:
    return (
        f"WITH base AS ({table.duckdb()}), fences AS ({fences(table)}) SELECT b.* REPLACE ("
        f"CASE WHEN b.{c} < f.lower_fence THEN f.lower_fence WHEN b.{c} > f.upper_fence THEN f.upper_fence ELSE b.{c} END AS {c}) "
        f"FROM base b, (SELECT * FROM fences WHERE \"column\" = '{c}') f"
    )


CHANGED_VERSIONS = """
SELECT position, "column", filled, modified, nullified, modified + nullified AS mutations, CAST(0 AS BIGINT) AS rows_dropped FROM (
  SELECT 0 AS position, 'o_custkey' AS "column", CAST(0 AS BIGINT) AS filled, CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS nullified
  UNION ALL SELECT 1, 'o_orderstatus', 0, 0, 0
  UNION ALL SELECT 2, 'o_totalprice', 0, count(*) FILTER (WHERE o_orderkey % 1009 = 3),
                   count(*) FILTER (WHERE o_orderkey % 2003 = 5 AND o_orderkey % 1009 <> 3) FROM orders
  UNION ALL SELECT 3, 'o_orderdate', 0, 0, 0
  UNION ALL SELECT 4, 'o_orderpriority', 0, count(*) FILTER (WHERE o_orderkey % 4001 = 7), 0 FROM orders) v
"""


def oracle_sql() -> dict[str, str]:
    return {
        # Sources, sinks and preparation
        "csv_round_trip": with_base(CUSTOMERS, "SELECT * FROM base"),
        "csv_inferred_types": "SELECT * FROM orders",
        "csv_round_trip_documents": "SELECT * FROM documents",
        "csv_round_trip_conversations": "SELECT * FROM conversations",
        "csv_round_trip_events": "SELECT * FROM events",
        "normalise_nulls": with_base(EVENTS, "SELECT * FROM base"),
        "row_index": "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index, * FROM orders",
        # Profile
        "null_counts": null_counts(CUSTOMERS),
        "null_counts_events": null_counts(EVENTS),
        "distinct_counts": distinct_counts(CUSTOMERS),
        "distinct_counts_events": distinct_counts(EVENTS),
        "distinct_counts_lineitem": distinct_counts(LINEITEM),
        "distinct_counts_documents": distinct_counts(DOCUMENTS),
        "distinct_counts_embeddings": distinct_counts(EMBEDDINGS),
        "profile_empty": profile_numeric(ORPHANED_ORDERS),
        "profile_numeric": profile_numeric(LINEITEM),
        "profile_numeric_messy": profile_numeric(CUSTOMERS),
        "profile_strings": profile_texts(CUSTOMERS),
        "profile_strings_documents": profile_texts(DOCUMENTS),
        "profile_temporal": profile_texts(EVENTS),
        "top_values": top_values(CUSTOMERS),
        "top_values_lineitem": top_values(LINEITEM),
        "top_values_events": top_values(EVENTS),
        "top_values_pages": top_values(PAGES),
        "top_values_documents": top_values(DOCUMENTS),
        "top_values_conversations": top_values(CONVERSATIONS),
        "histogram": histogram(EVENTS),
        "histogram_lineitem": histogram(LINEITEM),
        "histogram_bands": histogram_bands(CUSTOMERS),
        "histogram_bands_documents": histogram_bands(DOCUMENTS),
        "outlier_bands": outlier_bands(EVENTS),
        "missing_matrix": missing_matrix(CUSTOMERS),
        "missing_blocks": missing_blocks(EVENTS, 1000),
        # Quantiles and outliers
        "iqr_fences": iqr_fences(CUSTOMERS),
        "iqr_fences_m3": iqr_fences(EVENTS, 3.0),
        "iqr_fences_lineitem": iqr_fences(LINEITEM),
        "iqr_fences_part": iqr_fences(PART),
        "medians": medians(LINEITEM),
        "medians_large_keys": large_medians(KEYS),
        "iqr_fences_large_keys": large_fences(KEYS, "big_key"),
        "quantile_values_large_keys": quantile_values(KEYS, EXACT_KEYS, (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)),
        "outlier_counts": outlier_counts(EVENTS),
        "outlier_counts_labels": outlier_counts(LABELS),
        "outlier_counts_lineitem": outlier_counts(LINEITEM),
        "outlier_rows": outlier_rows(EVENTS),
        "outlier_rows_documents": outlier_rows(DOCUMENTS, ["n_chars"]),
        # Duplicates
        "duplicate_count": duplicate_count(CUSTOMERS),
        "duplicate_count_subset": duplicate_count(CUSTOMERS, ["segment", "nation_key"]),
        "duplicate_count_events": duplicate_count(EVENTS),
        "duplicate_count_lineitem": duplicate_count(LINEITEM, ["l_orderkey", "l_linenumber"]),
        "duplicate_rows": duplicate_rows(EVENTS),
        "duplicate_rows_subset": duplicate_rows(CUSTOMERS, ["segment", "nation_key"]),
        "duplicate_rows_documents": duplicate_rows(DOCUMENTS, ["text"]),
        "duplicate_rows_embeddings": duplicate_rows(EMBEDDINGS, ["embedding"]),
        "dup_subset_invalid": duplicate_rows(DOCUMENTS, ["text", "lang"]),
        "duplicate_rows_pages": duplicate_rows(PAGES, ["html"]),
        "duplicate_flag": duplicate_flags(CUSTOMERS, names(CUSTOMERS)),
        "duplicate_flag_unknown_names": with_base(CUSTOMERS, "SELECT *, 'Normal Record' AS is_duplicate FROM base"),
        "drop_duplicates": drop_duplicates(EVENTS, ["row_id", *names(EVENTS)]),
        "drop_duplicates_subset": drop_duplicates(DOCUMENTS, ["doc_id", *names(DOCUMENTS)], ["text"]),
        # Anomalies
        "anomaly_null_columns": anomalies(CUSTOMERS, "null_column"),
        "anomaly_zero_columns": anomalies(CUSTOMERS, "zero_column"),
        "anomaly_mixed_numeric": anomalies(EVENTS, "mixed_numeric"),
        "anomaly_email": anomalies(EVENTS, "malformed_email"),
        "anomaly_date": anomalies(EVENTS, "unreadable_date"),
        # Scores and reports
        "enriched_profile": enriched(CUSTOMERS),
        "enriched_profile_events": enriched(EVENTS),
        "enriched_profile_lineitem": enriched(LINEITEM),
        "enriched_profile_documents": enriched(DOCUMENTS),
        "enriched_profile_pages": enriched(PAGES),
        "audit_values": audit_values(CUSTOMERS),
        "audit_values_events": audit_values(EVENTS),
        "audit_values_documents": audit_values(DOCUMENTS),
        "audit_values_pages": audit_values(PAGES),
        "column_scores": scores(CUSTOMERS),
        "column_scores_events": scores(EVENTS),
        "column_scores_orders": scores(ORDERS),
        "dataset_score": dataset_score(CUSTOMERS),
        "dataset_score_subset": dataset_score(EVENTS, ["user_id", "event_type"]),
        "grades": grades(EVENTS),
        "issues": issues(CUSTOMERS),
        "issues_events": issues(EVENTS),
        "dataset_summary": summary(CUSTOMERS),
        "overview": overview(EVENTS),
        "column_table": column_table(CUSTOMERS),
        "score_bands": score_bands(EVENTS),
        # Repair
        "suggestions": suggestions(CUSTOMERS),
        "suggestions_events": suggestions(EVENTS),
        "clean_all": clean_all(CUSTOMERS),
        "clean_all_events": clean_all(EVENTS),
        "change_log": change_log(CUSTOMERS),
        "change_log_events": change_log(EVENTS),
        "change_log_joined": change_log(EVENTS),
        "change_log_versions": CHANGED_VERSIONS,
        "file_row_ids": "SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber FROM lineitem",
        "distinct_estimates": with_base(
            LINEITEM,
            union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, TRUE AS near FROM base" for c, *_ in LINEITEM.columns]),
        ),
        "clean_all_subset": clean_all(EVENTS, ["user_id", "event_type"]),
        "change_log_subset": change_log(EVENTS, ["user_id", "event_type"]),
        "duplicates_after_repair": "SELECT CAST(0 * count(*) AS BIGINT) AS duplicate_count FROM events",
        "fill_large_integers": fill(KEYS, "big_key", middle_two("big_key", "CAST((CAST(a AS HUGEINT) + b) // 2 AS BIGINT)")),
        "fill_decimal": with_base(
            KEYS,
            "SELECT * REPLACE (coalesce(CAST(price AS DECIMAL(18, 3)), (SELECT CAST(median(CAST(price AS DOUBLE)) AS DECIMAL(18, 3)) FROM base)) AS price) FROM base",
        ),
        "generated_ids": "SELECT * FROM orders",
        "fill_median": fill(EVENTS, "value", "(SELECT median(value) FROM base)"),
        "fill_all_null": fill(CUSTOMERS, "null_col", "0.0"),
        "fill_boolean": fill(EVENTS, "is_large", "FALSE"),
        "fill_string": fill(EVENTS, "event_type", "'Unknown'"),
        "fill_temporal_skip": with_base(EVENTS, "SELECT * FROM base"),
        "clamp_outliers": clamp(EVENTS, "value"),
        "clamp_outliers_documents": (
            f"WITH base AS ({DOCUMENTS.duckdb()}), fences AS ({fences(DOCUMENTS)}) SELECT b.* REPLACE ("
            "CAST(CASE WHEN n_chars < ceil(lower_fence) THEN ceil(lower_fence) WHEN n_chars > floor(upper_fence) "
            "THEN floor(upper_fence) ELSE n_chars END AS BIGINT) AS n_chars) FROM base b, "
            "(SELECT * FROM fences WHERE \"column\" = 'n_chars') f"
        ),
    }
