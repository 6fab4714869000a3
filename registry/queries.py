"""The registered queries: every operator of the library over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablewarden as tw
from tablewarden.operators.remedies import CAP_OUTLIERS, FILL_MISSING
from tablewarden.sources.scratch import scratch_path

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

Query = Callable[[SparkSession, str], DataFrame]


def over(table: Audited, build: Callable[[DataFrame, str | None], DataFrame]) -> Query:
    """A query that builds its result from a view and the view's row id."""
    return lambda spark, sf_dir: build(table.spark(spark, sf_dir), table.row_id)


def on_hub(table: Audited, build: Callable[[DataFrame], DataFrame], settings: tw.Settings = tw.DEFAULTS) -> Query:
    """A query over the enriched profile of a view."""
    return over(table, lambda df, rid: build(tw.enriched_profile(df, rid, settings, with_top_values=False)))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = CUSTOMERS.spark(spark, sf_dir)
    path = scratch_path(spark, "csv")
    tw.write_csv(df, path)
    return tw.read_csv(spark, path, schema=df.schema)


def csv_round_trip_of(table: str) -> Query:
    """A table with line breaks in its texts, written and read back without being told its types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        path = scratch_path(spark, "csv")
        tw.write_csv(df, path)
        return tw.read_csv(spark, path).select(*[F.col(name).cast(kind).alias(name) for name, kind in df.dtypes])

    return run


def csv_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    tw.write_csv(ORDERS.spark(spark, sf_dir), path)
    # Inference reads wall-clock times as instants of the session time zone.
    return tw.read_csv(spark, path).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def numeric_profile(df: DataFrame, row_id: str | None) -> DataFrame:
    return (
        tw.profile(df, row_id)
        .where(F.col("type_class") == "numeric")
        .select(
            "column",
            "total_rows",
            "missing_count",
            "unique_count",
            "min_number",
            "max_number",
            F.round("mean_value", 4).alias("mean_value"),
            F.round("std_value", 4).alias("std_value"),
        )
    )


def text_profile(df: DataFrame, row_id: str | None) -> DataFrame:
    return (
        tw.profile(df, row_id)
        .where(F.col("type_class") != "numeric")
        .select("column", "total_rows", "missing_count", "unique_count", "min_text", "max_text")
    )


def top() -> Callable[[DataFrame, str | None], DataFrame]:
    return lambda df, rid: tw.top_values(df, rid).select("column", "rank", "value", "count")


def hub_values(df: DataFrame, row_id: str | None) -> DataFrame:
    """What an audit knows about the values of each column, the most frequent ones included."""
    best = F.transform("top_values", lambda v: F.concat_ws("=", v["value"], v["count"].cast("string")))
    return tw.audit(df, row_id).profile.select(
        "position",
        "column",
        "min_number",
        "max_number",
        "min_text",
        "max_text",
        F.round("mean_value", 4).alias("mean_value"),
        F.round("std_value", 4).alias("std_value"),
        F.array_join(best, "|").alias("top_values"),
    )


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """The type of a filled whole-number column depends on its median; its values do not."""
    return df.withColumns({c: F.col(c).cast("double") for c in names if c in df.columns})


def anomaly(kind: str) -> Callable[[DataFrame, str | None], DataFrame]:
    return lambda df, rid: (
        tw.anomalies(df, rid).where(F.col("kind") == kind).select("column", "kind", "issue", "affected_rows")
    )


def known(hub: DataFrame) -> DataFrame:
    return hub.select(
        "position",
        "column",
        "dtype",
        "type_class",
        "total_rows",
        "missing_count",
        "missing_percentage",
        "unique_count",
        "outlier_count",
        "lower_fence",
        "upper_fence",
        "mismatch_count",
        "dataset_duplicate_count",
    )


def graded(hub: DataFrame) -> DataFrame:
    return tw.with_grade(tw.column_scores(hub).select("column", "score"))


def summary(hub: DataFrame) -> DataFrame:
    parts = ("column", "metric", "severity", "score_impact", "description")
    line = F.transform("issues", lambda i: F.concat_ws(" / ", *[i[p].cast("string") for p in parts]))
    return tw.dataset_summary(hub).withColumn("issues", F.array_join(line, "; "))


def suggested(hub: DataFrame) -> DataFrame:
    return tw.suggest_fixes(hub).select("*", "details.*").drop("details")


def fixed(column: str, action: str = FILL_MISSING) -> Callable[[DataFrame, str | None], DataFrame]:
    """One fix on one column, all others pass through; fences come from the table itself."""

    def build(df: DataFrame, row_id: str | None) -> DataFrame:
        fix = tw.Fix(column, action)
        if action == CAP_OUTLIERS:
            fence = tw.outlier_counts(df, row_id, [column]).first()
            fix = tw.Fix(column, action, fence["lower_fence"], fence["upper_fence"])
        return tw.apply_fixes(df, [fix], row_id)

    return build


def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are added, used, and gone again in the file."""
    keyed, name = tw.with_row_id(ORDERS.spark(spark, sf_dir))
    unique = keyed.join(tw.duplicate_rows(keyed, name), name, "left_anti")
    path = scratch_path(spark, "csv")
    tw.write_csv(unique, path)
    return tw.read_csv(spark, path, schema=ORDERS.spark(spark, sf_dir).schema)


BY_USER_AND_TYPE = tw.Settings(duplicate_subset=("user_id", "event_type"))


def joined_log(df: DataFrame, row_id: str | None) -> DataFrame:
    return tw.change_log(df, tw.repair(df, row_id).cleaned, row_id)


def versions_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table with a few changes in two columns."""
    before = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = "CASE WHEN o_orderkey % 1009 = 3 THEN o_totalprice + 1 WHEN o_orderkey % 2003 = 5 THEN NULL ELSE o_totalprice END AS o_totalprice"
    priority = "CASE WHEN o_orderkey % 4001 = 7 THEN concat(o_orderpriority, '!') ELSE o_orderpriority END AS o_orderpriority"
    after = before.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", price, "o_orderdate", priority)
    return tw.change_log(before, after, "o_orderkey")


def file_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, row_id = tw.read_parquet_with_row_id(spark, f"{sf_dir}/lineitem.parquet")
    return df.select(F.col(row_id).alias("row_id"), "l_orderkey", "l_linenumber")


def estimates_near_counts(df: DataFrame, row_id: str | None) -> DataFrame:
    """Exact counts, and whether estimates lie within four standard errors of them."""
    found = tw.distinct_estimates(tw.distinct_sketches(df, row_id)).join(tw.distinct_counts(df, row_id).select("position", "unique_count"), "position")
    near = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 1 + 4 * F.col("standard_error") * F.col("unique_count")
    return found.select("column", "unique_count", near.alias("near"))


def queries() -> dict[str, Query]:
    return {
        # Sources, sinks and preparation
        "csv_round_trip": csv_round_trip,
        "csv_inferred_types": csv_inferred_types,
        "csv_round_trip_documents": csv_round_trip_of("documents"),
        "csv_round_trip_conversations": csv_round_trip_of("conversations"),
        "csv_round_trip_events": csv_round_trip_of("events"),
        "normalise_nulls": over(EVENTS, lambda df, rid: tw.normalise_nulls(df)),
        "row_index": over(
            ORDERS,
            lambda df, rid: tw.row_index(df, ["o_orderdate", "o_orderkey"]),
        ),
        # Profile
        "null_counts": over(CUSTOMERS, tw.null_counts),
        "null_counts_events": over(EVENTS, tw.null_counts),
        "distinct_counts": over(CUSTOMERS, tw.distinct_counts),
        "distinct_counts_events": over(EVENTS, tw.distinct_counts),
        "distinct_counts_lineitem": over(LINEITEM, tw.distinct_counts),
        "distinct_counts_documents": over(DOCUMENTS, tw.distinct_counts),
        "distinct_counts_embeddings": over(EMBEDDINGS, tw.distinct_counts),
        "profile_empty": over(ORPHANED_ORDERS, numeric_profile),
        "profile_numeric": over(LINEITEM, numeric_profile),
        "profile_numeric_messy": over(CUSTOMERS, numeric_profile),
        "profile_strings": over(CUSTOMERS, text_profile),
        "profile_strings_documents": over(DOCUMENTS, text_profile),
        "profile_temporal": over(EVENTS, text_profile),
        "top_values": over(CUSTOMERS, top()),
        "top_values_lineitem": over(LINEITEM, top()),
        "top_values_events": over(EVENTS, top()),
        "top_values_pages": over(PAGES, top()),
        "top_values_documents": over(DOCUMENTS, top()),
        "top_values_conversations": over(CONVERSATIONS, top()),
        "histogram": over(EVENTS, tw.histogram),
        "histogram_lineitem": over(LINEITEM, tw.histogram),
        "histogram_bands": over(CUSTOMERS, tw.histogram_bands),
        "histogram_bands_documents": over(DOCUMENTS, tw.histogram_bands),
        "outlier_bands": over(EVENTS, tw.outlier_bands),
        "missing_matrix": over(CUSTOMERS, tw.missing_matrix),
        "missing_blocks": over(EVENTS, lambda df, rid: tw.missing_blocks(df, rid, 1000)),
        # Quantiles and outliers
        "iqr_fences": over(CUSTOMERS, tw.iqr_fences),
        "iqr_fences_m3": over(EVENTS, lambda df, rid: tw.iqr_fences(df, rid, 3.0)),
        "iqr_fences_lineitem": over(LINEITEM, tw.iqr_fences),
        "iqr_fences_part": over(PART, tw.iqr_fences),
        "medians": over(LINEITEM, lambda df, rid: tw.medians(df, rid).select("column", "median")),
        "medians_large_keys": over(KEYS, lambda df, rid: tw.medians(df.select(rid, "big_key", "price", "o_custkey"), rid).select("column", "median")),
        "iqr_fences_large_keys": over(KEYS, lambda df, rid: tw.iqr_fences(df.select(rid, "big_key"), rid).drop("position")),
        "quantile_values_large_keys": over(KEYS, lambda df, rid: tw.quantile_values(df.select(rid, *EXACT_KEYS), rid, (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)).select("column", "quantile", "value")),
        "outlier_counts": over(EVENTS, tw.outlier_counts),
        "outlier_counts_labels": over(LABELS, tw.outlier_counts),
        "outlier_counts_lineitem": over(LINEITEM, tw.outlier_counts),
        "outlier_rows": over(EVENTS, tw.outlier_rows),
        "outlier_rows_documents": over(DOCUMENTS, lambda df, rid: tw.outlier_rows(df, rid, ["n_chars"])),
        # Duplicates
        "duplicate_count": over(CUSTOMERS, tw.duplicate_count),
        "duplicate_count_subset": over(
            CUSTOMERS, lambda df, rid: tw.duplicate_count(df, rid, ["segment", "nation_key"])
        ),
        "duplicate_count_events": over(EVENTS, tw.duplicate_count),
        "duplicate_count_lineitem": over(
            LINEITEM, lambda df, rid: tw.duplicate_count(df, rid, ["l_orderkey", "l_linenumber"])
        ),
        "duplicate_rows": over(EVENTS, tw.duplicate_rows),
        "duplicate_rows_subset": over(CUSTOMERS, lambda df, rid: tw.duplicate_rows(df, rid, ["segment", "nation_key"])),
        "duplicate_rows_documents": over(DOCUMENTS, lambda df, rid: tw.duplicate_rows(df, rid, ["text"])),
        "duplicate_rows_embeddings": over(EMBEDDINGS, lambda df, rid: tw.duplicate_rows(df, rid, ["embedding"])),
        # Names that are no columns of the table are left out of the subset.
        "dup_subset_invalid": over(
            DOCUMENTS, lambda df, rid: tw.duplicate_rows(df, rid, ["text", "no_such_column", "lang"])
        ),
        "duplicate_rows_pages": over(PAGES, lambda df, rid: tw.duplicate_rows(df, rid, ["html"])),
        "duplicate_flag": over(
            CUSTOMERS,
            lambda df, rid: tw.duplicate_flags(df, rid),
        ),
        "duplicate_flag_unknown_names": over(CUSTOMERS, lambda df, rid: tw.duplicate_flags(df, rid, ["absent"])),
        "drop_duplicates": over(
            EVENTS, lambda df, rid: tw.drop_duplicates(df, rid)
        ),
        "drop_duplicates_subset": over(
            DOCUMENTS,
            lambda df, rid: tw.drop_duplicates(df, rid, ["text"]),
        ),
        # Anomalies
        "anomaly_null_columns": over(CUSTOMERS, anomaly("null_column")),
        "anomaly_zero_columns": over(CUSTOMERS, anomaly("zero_column")),
        "anomaly_mixed_numeric": over(EVENTS, anomaly("mixed_numeric")),
        "anomaly_email": over(EVENTS, anomaly("malformed_email")),
        "anomaly_date": over(EVENTS, anomaly("unreadable_date")),
        # Scores and reports
        "enriched_profile": on_hub(CUSTOMERS, known),
        "enriched_profile_events": on_hub(EVENTS, known),
        "enriched_profile_lineitem": on_hub(LINEITEM, known),
        "enriched_profile_documents": on_hub(DOCUMENTS, known),
        "enriched_profile_pages": on_hub(PAGES, known),
        "audit_values": over(CUSTOMERS, hub_values),
        "audit_values_events": over(EVENTS, hub_values),
        "audit_values_documents": over(DOCUMENTS, hub_values),
        "audit_values_pages": over(PAGES, hub_values),
        "column_scores": on_hub(CUSTOMERS, tw.column_scores),
        "column_scores_events": on_hub(EVENTS, tw.column_scores),
        "column_scores_orders": on_hub(ORDERS, tw.column_scores),
        "dataset_score": on_hub(CUSTOMERS, tw.dataset_score),
        "dataset_score_subset": on_hub(
            EVENTS, tw.dataset_score, tw.Settings(duplicate_subset=("user_id", "event_type"))
        ),
        "grades": on_hub(EVENTS, graded),
        "issues": on_hub(CUSTOMERS, tw.issues),
        "issues_events": on_hub(EVENTS, tw.issues),
        "dataset_summary": on_hub(CUSTOMERS, summary),
        "overview": on_hub(EVENTS, tw.overview),
        "column_table": on_hub(CUSTOMERS, tw.column_table),
        "score_bands": on_hub(EVENTS, tw.score_bands),
        # Repair
        "suggestions": on_hub(CUSTOMERS, suggested),
        "suggestions_events": on_hub(EVENTS, suggested),
        "clean_all": over(CUSTOMERS, lambda df, rid: doubles(tw.repair(df, rid).cleaned, "nation_key")),
        "clean_all_subset": over(EVENTS, lambda df, rid: tw.repair(df, rid, BY_USER_AND_TYPE).cleaned),
        "change_log_subset": over(EVENTS, lambda df, rid: tw.repair(df, rid, BY_USER_AND_TYPE).change_log),
        "duplicates_after_repair": over(
            EVENTS, lambda df, rid: tw.duplicate_count(df.join(tw.repair(df, rid, BY_USER_AND_TYPE).cleaned, rid, "left_semi"), rid, BY_USER_AND_TYPE.subset)
        ),
        "clean_all_events": over(EVENTS, lambda df, rid: tw.repair(df, rid).cleaned),
        "change_log": over(CUSTOMERS, lambda df, rid: tw.repair(df, rid).change_log),
        "change_log_events": over(EVENTS, lambda df, rid: tw.repair(df, rid).change_log),
        "change_log_joined": over(EVENTS, joined_log),
        "change_log_versions": versions_log,
        "file_row_ids": file_row_ids,
        "distinct_estimates": over(LINEITEM, estimates_near_counts),
        "fill_median": over(EVENTS, fixed("value")),
        "fill_large_integers": over(KEYS, fixed("big_key")),
        "fill_decimal": over(KEYS, lambda df, rid: fixed("price")(df, rid).withColumn("price", F.col("price").cast("decimal(18,3)"))),
        "generated_ids": generated_ids,
        "fill_all_null": over(CUSTOMERS, fixed("null_col")),
        "fill_boolean": over(EVENTS, fixed("is_large")),
        "fill_string": over(EVENTS, fixed("event_type")),
        "fill_temporal_skip": over(EVENTS, fixed("ts")),
        "clamp_outliers": over(EVENTS, fixed("value", CAP_OUTLIERS)),
        "clamp_outliers_documents": over(DOCUMENTS, fixed("n_chars", CAP_OUTLIERS)),
    }
