"""Value frequencies: exact distinct counts and the most frequent values.

Values are unpivoted per storage kind, counted before and after one shuffle, and never leave the
executors. A value that fills a third of a table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import OTHER, AuditColumn, audited_columns, batches, union_all
from ..functions.sqltext import array, quote, struct, text
from .rows import normalise_nulls

TOP = 5
COLUMNS_PER_PASS = 40

# Longer values travel as a digest of the whole value; the digest text itself is longer than this,
# so it can not be mistaken for a short value.
SHORT_BYTES = 64
_DIGEST_PREFIX = "sha256:"
_DIGEST_LENGTH = len(_DIGEST_PREFIX) + 64
# Characters by which texts are told apart that begin alike, step by step; every step is one more read of these.
_DESCENT = (256,)
# Most copies of one text that meet in a task while the texts of the winners are fetched.
_SALTS = 64

_RANKED = "STRUCT<rank: INT, value: STRING, count: BIGINT>"
_VALUE_LIST = "ARRAY<STRUCT<value: STRING, count: BIGINT>>"
NO_VALUES = f"CAST(array() AS {_VALUE_LIST})"


def compact_key(value: str) -> str:
    """A text that is equal exactly when the values are: short ones as they are, long ones as digest."""
    return (
        f"CASE WHEN octet_length({value}) <= {SHORT_BYTES} THEN CAST({value} AS STRING) "
        f"WHEN {value} IS NOT NULL THEN concat('{_DIGEST_PREFIX}', sha2({value}, 256)) END"
    )


def _ordered_key(value: str) -> str:
    """A compact key that sorts like the value up to the characters it keeps of long ones."""
    return (
        f"CASE WHEN octet_length({value}) <= {SHORT_BYTES} THEN CAST({value} AS STRING) "
        f"WHEN {value} IS NOT NULL THEN concat(left({value}, {SHORT_BYTES}), '{_DIGEST_PREFIX}', sha2({value}, 256)) END"
    )


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def _key(c: AuditColumn) -> tuple[str, str] | None:
    """Kind and value of the frequency key of a column; map columns have none."""
    kind = c.data_type
    if isinstance(kind, T.MapType):
        return None
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "bigint", f"CAST({c.sql} AS BIGINT)"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", f"CAST({c.sql} AS DOUBLE)"
    if is_text(kind):
        return "string", _ordered_key(c.sql)
    if isinstance(kind, T.BinaryType):
        return "digest", f"CASE WHEN {c.sql} IS NOT NULL THEN sha2({c.sql}, 256) END"
    if isinstance(kind, T.VariantType):
        return "digest", f"CASE WHEN {c.sql} IS NOT NULL THEN sha2(to_json({c.sql}), 256) END"
    # Dates, timestamps, intervals, decimals and nested values group as they are, just as they do when
    # rows are compared: two instants may print alike, and 0.0 equals -0.0 at any depth.
    return c.dtype, c.sql


def _printed(c: AuditColumn) -> str:
    """Text of a frequency key in the type of its column."""
    if isinstance(c.data_type, T.BooleanType):
        return "CAST(CAST(key AS BOOLEAN) AS STRING)"
    if isinstance(c.data_type, T.FloatType):
        return "CAST(CAST(key AS FLOAT) AS STRING)"
    return "CAST(key AS STRING)"


def _split(columns: list[AuditColumn]) -> list[list[tuple[AuditColumn, str]]]:
    """Columns by key type, in batches: each batch is one narrow relation over one pruned scan."""
    kinds: dict[str, list[tuple[AuditColumn, str]]] = {}
    for c in columns:
        found = _key(c)
        if found is not None:
            kinds.setdefault(found[0], []).append((c, found[1]))
    return [list(group) for kind in kinds.values() for group in batches(kind, COLUMNS_PER_PASS)]


def _unpivoted(df: DataFrame, values: dict[int, str], name: str) -> DataFrame:
    """(position, value) of the non-null values of expressions of one type."""
    wide = df.selectExpr(*[f"{value} AS {quote(str(position))}" for position, value in values.items()])
    return (
        wide.unpivot([], list(wide.columns), "position", name)
        .where(f"{name} IS NOT NULL")
        # The default never applies; it tells the optimizer that positions are not null. Otherwise it
        # adds null checks to some uses of a relation, and their shuffle would not be shared.
        .withColumn("position", F.expr("coalesce(CAST(position AS INT), -1)"))
    )


def _frequencies(df: DataFrame, group: list[tuple[AuditColumn, str]]) -> DataFrame:
    """(position, key, count) over the non-null values of a batch of columns."""
    values = _unpivoted(df, {c.position: key for c, key in group}, "key")
    return values.groupBy("position", "key").agg(F.count(F.lit(1)).alias("count"))


def _keys_counted(df: DataFrame, columns: list[AuditColumn], counted: list[DataFrame]) -> DataFrame:
    """(position, n) with n = 1 per distinct value, and one row with 0 per column (null for map columns)."""
    zeros = [
        struct({"position": str(c.position), "n": f"CAST({'0' if _key(c) else 'NULL'} AS BIGINT)"}) for c in columns
    ]
    # The count is read, though only its sign matters: the same frequencies then serve both the
    # distinct counts and the top values from one shuffle.
    keys = [f.selectExpr("position", "CAST(count > 0 AS BIGINT) AS n") for f in counted]
    return union_all([df.sparkSession.sql(f"SELECT inline({array(zeros)})"), *keys])


def _top(df: DataFrame, group: list[tuple[AuditColumn, str]], counted: DataFrame, n: int) -> DataFrame:
    """(position, column, rank, value, count) of the n most frequent values per column."""
    texts = [c for c, _ in group if is_text(c.data_type)]
    if texts:
        best = _best_texts(df, texts, counted, n)
    else:
        order = Window.partitionBy("position").orderBy(F.desc("count"), "key")
        best = counted.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= n)
    names = " ".join(f"WHEN {c.position} THEN {text(c.name)}" for c, _ in group)
    prints = " ".join(f"WHEN {c.position} THEN {_printed(c)}" for c, _ in group)
    rank = "rank" if not texts else "0 AS rank"
    winners = best.selectExpr("position", f"CASE position {names} END AS column", rank, "key", f"CASE position {prints} END AS value", "count")
    if not texts:
        return winners.drop("key")
    whole = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"))
    ranked = _with_long_texts(df, texts, winners).withColumn("rank", F.row_number().over(whole))
    return ranked.where(F.col("rank") <= n)


def _first_groups(groups: DataFrame, n: int) -> DataFrame:
    """Groups of texts with one count and beginning, down to the one that holds the last of ``left`` places.

    ``whole`` groups fit as they are; the last may hold more texts than places, ``left`` then says how many
    it has. The rank filter runs before the shuffle too, so a task sends n small rows per column at most.
    """
    order = Window.partitionBy("position").orderBy(F.desc("count"), "begin", "long")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return (
        first.withColumn("upto", F.sum("same").over(upto))
        .where("upto - same < left")
        .selectExpr("position", "count", "begin", "long", "left - upto + same AS left", "upto <= left AS whole")
    )


def _best_texts(df: DataFrame, texts: list[AuditColumn], counted: DataFrame, n: int) -> DataFrame:
    """(position, key, count) of the n best texts per column, and of those that tie with the last one for long.

    Texts are ranked by count and by their beginning, as groups of equal ones. Where the last group has more
    texts than places, its texts are told apart by the next characters, for these texts only; then by more.
    Only keys and beginnings travel. If no group is too large, the adaptive plan finds the small side
    empty and does not read the table again.
    """
    on = ["position", "count", "begin", "long"]
    keys = counted.selectExpr(
        "position",
        "key",
        "count",
        # The defaults never apply; like that of positions they keep the shuffle of the counts shared.
        f"coalesce(CASE WHEN octet_length(key) > {SHORT_BYTES} THEN left(key, length(key) - {_DIGEST_LENGTH}) ELSE key END, '') AS begin",
        f"coalesce(octet_length(key) > {SHORT_BYTES}, false) AS long",
        f"{n}L AS left",
    )
    found, length = [], SHORT_BYTES
    for more in (*_DESCENT, None):
        # At most n rows per column.
        first = _first_groups(keys.groupBy(*on, "left").agg(F.count(F.lit(1)).alias("same")), n)
        if more is None:
            found.append(keys.join(F.broadcast(first), on, "left_semi").select("position", "key", "count"))
            return union_all(found)
        found.append(keys.join(F.broadcast(first.where("whole")), on, "left_semi").select("position", "key", "count"))
        tied = first.where("NOT whole").selectExpr("position", "begin AS known", "count AS wanted", "left")
        long = {c.position: f"CASE WHEN octet_length({c.sql}) > {SHORT_BYTES} THEN {c.sql} END" for c in texts}
        rows = _unpivoted(df, long, "long_text").selectExpr("*", f"left(long_text, {length}) AS known")
        length += more
        keys = (
            rows.join(F.broadcast(tied), ["position", "known"])
            .selectExpr("position", f"{_ordered_key('long_text')} AS key", f"left(long_text, {length}) AS begin", "wanted", "left")
            .groupBy("position", "key", "begin", "wanted", "left")
            .agg(F.count(F.lit(1)).alias("count"))
            .where("count = wanted")
            .selectExpr("position", "key", "count", "begin", "true AS long", "left")
        )


def distinct_counts(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Exact number of distinct non-null values per column; map columns report null."""
    df = normalise_nulls(df)
    columns = audited_columns(df, row_id)
    if not columns:
        return df.sparkSession.createDataFrame([], "position int, column string, unique_count bigint")
    names = ", ".join(f"{c.position}, {text(c.name)}" for c in columns)
    return (
        _keys_counted(df, columns, [_frequencies(df, group) for group in _split(columns)])
        .groupBy("position")
        .agg(F.sum("n").alias("unique_count"))
        .selectExpr("position", f"element_at(map({names}), position) AS column", "unique_count")
    )


def top_values(df: DataFrame, row_id: str | None = None, n: int = TOP) -> DataFrame:
    """The n most frequent non-null values per column; equal counts order by value, whatever its length.

    Long texts are counted by digest. Their texts are fetched only for the winners, and for texts that tie
    with the last one in count and in its first 320 characters.
    """
    df = normalise_nulls(df)
    columns = [c for c in audited_columns(df, row_id) if c.type_class != OTHER]
    parts = [_top(df, group, _frequencies(df, group), n) for group in _split(columns)]
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, column string, rank int, value string, count bigint")
    return union_all(parts)


def value_summary(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Distinct count and the five most frequent values per column, from the same shuffled frequencies."""
    df = normalise_nulls(df)
    columns = audited_columns(df, row_id)
    if not columns:
        return df.sparkSession.createDataFrame([], f"position int, unique_count bigint, top_values {_VALUE_LIST}")
    groups = _split(columns)
    counted = [_frequencies(df, group) for group in groups]
    entry = "named_struct('rank', rank, 'value', value, 'count', count)"
    parts = [_keys_counted(df, columns, counted).selectExpr("position", "n", f"CAST(NULL AS {_RANKED}) AS entry")]
    for group, frequencies in zip(groups, counted, strict=True):
        if group[0][0].type_class != OTHER:
            top = _top(df, group, frequencies, TOP)
            parts.append(top.selectExpr("position", "0L AS n", f"{entry} AS entry"))
    # Only the few top entries are collected: the rows of distinct values carry none.
    entries = "transform(array_sort(collect_list(entry)), e -> named_struct('value', e.value, 'count', e.count))"
    return (
        union_all(parts)
        .groupBy("position")
        .agg(F.sum("n").alias("unique_count"), F.expr(f"CAST({entries} AS {_VALUE_LIST})").alias("top_values"))
    )


def _with_long_texts(df: DataFrame, texts: list[AuditColumn], winners: DataFrame) -> DataFrame:
    """Winners with digests replaced by the texts they stand for.

    If none is a digest, the adaptive plan sees the empty side first and never reads the table again.
    Copies of a text are reduced to one per salt before they meet, as a winner may fill every task.
    """
    wanted = winners.where(F.octet_length("key") > SHORT_BYTES).select("position", "key")
    long = {c.position: f"CASE WHEN octet_length({c.sql}) > {SHORT_BYTES} THEN {c.sql} END" for c in texts}
    found = (
        _unpivoted(df, long, "long_text")
        .selectExpr("position", f"{_ordered_key('long_text')} AS key", "long_text")
        .join(wanted, ["position", "key"], "left_semi")
        # All texts of a digest are equal, so the set holds one; unlike first() on texts it needs no sort.
        .groupBy("position", "key", F.expr(f"spark_partition_id() % {_SALTS} AS salt"))
        .agg(F.expr("element_at(collect_set(long_text), 1) AS long_text"))
        .groupBy("position", "key")
        .agg(F.expr("element_at(collect_set(long_text), 1) AS long_text"))
    )
    # Mostly few rows, but of texts of any length: Spark picks the join by their real size.
    return winners.join(found, ["position", "key"], "left").selectExpr(
        "position", "column", "rank", "coalesce(long_text, value) AS value", "count"
    )
