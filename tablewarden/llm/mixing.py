"""Mixing sources to target weights by hash thresholds.

Every row has a fixed hash. The words of a source are summed by hash bucket, and the budget of the
source ends inside one bucket; only that bucket is cut into finer ones, until a bucket holds next to
nothing. All rows below the last edge are taken, so rows are filtered by one comparison and never
sorted, and a smaller budget takes a subset of a larger one.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own and
the last in order; rows that agree in key and text have the same hash and are taken together; an
empty table gives an empty mix. Reruns agree: nothing depends on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged

#: Bits of the hash that a level of buckets adds, and the number of levels.
LEVEL_BITS = 12
LEVELS = 4
_PLACE_BITS = 63

WORD = r"[^ \t-\r]+"


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in order; ``share`` of all words is handed out; no source goes over ``most`` times itself."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(*key: Column) -> Column:
    """A hash from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*key), 1)


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source``, ``source_size``, ``target`` of rows with ``source`` and ``size``.

    Targets are weight times a level that is the same for all sources below their limit. Sources in the
    order of limit over weight reach their limit one after the other, so one pass finds the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.row_number().over(by_name) - 1) % len(mix.weights) + 1)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    limit = mix.most * F.col("source_size").cast("double")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sources.withColumn("limit", limit)
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("budget", mix.share * F.sum("source_size").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    target = F.least("limit", F.coalesce(first * F.col("weight"), F.col("limit")))
    return levels.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source its target, the copies of every row (``whole``) and the edge below which a row has one more (``edge``).

    ``sizes`` has ``source``, ``size`` and ``place``; it is read once for the targets and once a level.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = (
        source_targets(sizes, mix)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("cell", F.lit(0).cast("long"))
        .withColumn("held", F.lit(0.0))
    )
    shift = _PLACE_BITS
    for _ in range(LEVELS):
        state = staged(state, "mix-edges").alias("state")
        inside = (
            sizes.alias("sizes")
            .join(state.select("source", "cell").alias("state"), F.col("sizes.source").eqNullSafe(F.col("state.source")))
            .where(F.shiftrightunsigned("place", min(shift, 63)) == F.col("state.cell"))
        )
        shift -= LEVEL_BITS
        cells = inside.groupBy(F.col("sizes.source").alias("source"), F.shiftrightunsigned("place", shift).alias("cell")).agg(F.sum("size").alias("held"))
        # At most 2^LEVEL_BITS rows a source.
        up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("sum", F.sum("held").over(up_to)).alias("cells")
        below = F.col("cells.sum") <= F.col("state.rest")
        # The last cell, if the rest reaches beyond all of them, stays the edge.
        chosen = (
            state.join(cells, F.col("cells.source").eqNullSafe(F.col("state.source")), "left")
            .groupBy("state.source", "source_size", "target", "whole")
            .agg(
                F.min_by(F.struct("cells.cell", "cells.held", "cells.sum"), F.struct(below, F.when(below, -F.col("cells.cell")).otherwise(F.col("cells.cell")))).alias("edge"),
                F.first("rest").alias("rest"),
            )
        )
        state = chosen.select(
            "source",
            "source_size",
            "target",
            "whole",
            (F.col("rest") - F.coalesce(F.col("edge.sum") - F.col("edge.held"), F.lit(0))).alias("rest"),
            F.coalesce("edge.cell", F.lit(0)).alias("cell"),
            F.coalesce("edge.held", F.lit(0)).cast("double").alias("held"),
        )
    # The last bucket goes whole to the nearer side.
    nearer = (2 * F.col("rest") > F.col("held")).cast("long")
    edge = F.shiftleft(F.col("cell") + nearer, shift)
    return staged(state.select("source", "source_size", "target", "whole", F.when(F.col("rest") > 0, edge).otherwise(F.shiftleft("cell", shift)).alias("edge")), "mix-edges")


def mixed_sources(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``sizes`` with ``source_size``, ``target``, ``copies`` and ``taken`` (words taken, repeats counted)."""
    found = thresholds(sizes, mix).withColumnRenamed("source", "mix_source")
    copies = F.col("whole") + (F.col("place") < F.col("edge")).cast("long")
    return (
        sizes.join(found, sizes["source"].eqNullSafe(found["mix_source"]), "left")
        .withColumn("copies", F.least(copies, F.lit(mix.most)))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("mix_source", "whole", "edge")
    )


def document_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        place_of(F.col(key), F.col(text)).alias("place"),
    )
