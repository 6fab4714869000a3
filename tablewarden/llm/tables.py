"""Tables of the queries, and durable steps between jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: With this setting Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects garbage.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """The rows written once to the shared scratch folder and read back: no lineage, and a size that Spark knows.

    The path is added to ``made``, for those who delete the copy before the application ends. The shuffle
    files behind the rows go as soon as these are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if made is not None:
        made.append(path)
    before = spark.conf.get(_FILE_CLEANUP, "false")
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores where the frame has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_shipped: set[str] = set()
#: The driver serves the archive from here as long as it lives; no data is ever put here.
_archives = tempfile.TemporaryDirectory(prefix="tablewarden-code-")


def shipped(df: DataFrame) -> DataFrame:
    """The frame, after this package has been sent to the Python workers, once per application.

    Workers import the package by name and need not have it installed; Spark hands the archive out.
    """
    context: SparkContext = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(_archives.name, f"{context.applicationId}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    source = os.path.join(folder, name)
                    archive.write(source, os.path.relpath(source, os.path.dirname(package)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df
