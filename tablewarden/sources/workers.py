"""The library on Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: The driver serves the archive from here as long as it lives; no data is ever put here.
_archives = tempfile.TemporaryDirectory(prefix="tablewarden-core-")


def ship(spark: SparkSession) -> None:
    """Send the readers to the Python workers, once per application; workers need not have the library installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(_archives.name, f"{context.applicationId}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                source = os.path.join(folder, name)
                archive.write(source, os.path.relpath(source, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
