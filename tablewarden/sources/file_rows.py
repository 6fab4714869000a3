"""Row ids from the place of a row in its file."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import column
from ..functions.ids import new_id_name
from ..functions.local import local_rows

#: Most files whose first ids are sent to all executors: a path and a number each, about 20 MB.
BROADCAST_FILES = 100_000


def read_parquet_with_row_id(spark: SparkSession, path: str | list[str], broadcast_files: int = BROADCAST_FILES) -> tuple[DataFrame, str]:
    """A Parquet table with a generated row id, and the name of the id.

    Ids count 0, 1, 2 ... through the files in order of their paths. They come from the file and the
    position in it that Spark knows of every row, so they do not depend on splits, partitions, filters or
    the columns that are read, and nothing is written. Rows per file are counted from file footers when
    this is called; their running sum is joined by file. It is broadcast for up to ``broadcast_files``
    files; beyond that the rows are joined by file, in which each file is one key.
    """
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    name = new_id_name(df.columns)
    file, place, first = (new_id_name([*df.columns, name]) for _ in range(3))
    where = df.metadataColumn("_metadata")
    rows = df.select(where["file_path"].alias(file)).groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    found = rows.limit(broadcast_files + 1).collect()
    if len(found) <= broadcast_files:
        counts = dict(sorted((r[file], r["n"]) for r in found))
        starts = list(accumulate(counts.values(), initial=0))[:-1]
        schema = T.StructType([T.StructField(file, T.StringType()), T.StructField(first, T.LongType())])
        offsets = F.broadcast(local_rows(df, list(zip(counts, starts, strict=True)), schema))
    else:
        # A row per file, so the window stays small.
        before = F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
        offsets = rows.select(file, F.coalesce(before, F.lit(0)).cast("bigint").alias(first)).hint("merge")
    placed = df.select(*[column(c) for c in df.columns], where["file_path"].alias(file), where["row_index"].alias(place))
    row_id = (column(first) + column(place)).alias(name)
    return placed.join(offsets, file).select(*[column(c) for c in df.columns], row_id), name
