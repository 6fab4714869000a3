"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged


def components(links: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``links`` (``a``, ``b``).

    Every round a node takes the smallest label among its neighbours, and then the label of its label,
    so labels travel twice as far each round. Labels are written each round; only a count comes back.
    Paths of what is written are added to ``made``.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links", made).toDF("node", "near")
    labels = edges.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("component"))
    labels = staged(labels, "labels", made)
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = lower.join(far, "component", "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        moved = staged(moved, "labels", made)
        changed = moved.where("old != component").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
