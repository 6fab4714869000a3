"""Durable intermediate results.

Everything goes to the folder the cluster names in ``spark.checkpoint.dir``, so lost executors never
take an intermediate result with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ScratchFolderError

_made: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Root of the shared scratch folder; it must have been set on the session."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise ScratchFolderError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    path = f"{scratch_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_copies(spark: SparkSession) -> list[str]:
    """Paths of the copies that this application has in the scratch folder, oldest first."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def remove_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the copies that this application wrote to the scratch folder, all or the named ones.

    Frames that still read them fail afterwards. Checkpoints are not among them; Spark deletes those
    once their frames are gone if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    made = _made.get(context.applicationId, [])
    for path in [p for p in made if paths is None or p in paths]:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        made.remove(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its rows fixed in the scratch folder and its lineage cut."""
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)
