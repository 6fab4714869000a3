"""Centroid clustering over blocks of neighbouring vectors.

Vectors are turned into whole numbers and ordered along a Hilbert curve, and runs of neighbours become
blocks with a box: the smallest and the largest number of every component. In every round bounds of the
distances from the centroids to the points of a box tell which centroids cannot be the nearest of any
vector of the block; only the rest are compared with the vectors, all at once. Everything is exact
whole-number arithmetic: in doubles where every intermediate value fits their 53 bits, in Python's
integers otherwise.

A round sends sums per cluster and component to one small aggregation; only the centroids pass the
driver. Blocks and keyed vectors are written to the shared scratch folder, so a lost executor repeats
tasks, never a round. Equal vectors, however many, are dealt to range partitions by a stored random number.

Defined cases: vectors that are null, of another length, or hold a null or a component whose multiple is
not finite are left out, so they have no row; ids may be null or repeat, each row is a vector; of equal
hashes the smaller vector is the earlier start; with fewer vectors than clusters each vector starts one;
distances and sums above the range of a long are given as its largest value; an empty table gives no
rows. Only the id and the vector are read, so other columns can have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shipped, staged

#: Vectors of a block, and bits of a component on the curve.
BLOCK = 64
CURVE_BITS = 2
#: Up to this size all sums over 64 components that distances and bounds need stay below 2^53.
NARROW = 1 << 21
LARGEST = (1 << 63) - 1
#: Sums travel as limbs of so many bits, so that they fit a long whatever their size.
LIMB = 30

ROUND_SCHEMA = "cluster int, component int, limb int, total bigint"


@dataclass(frozen=True)
class Plan:
    """``clusters`` centroids over vectors of ``components`` numbers, each multiplied by ``scale`` and floored."""

    clusters: int = 16
    rounds: int = 3
    components: int = 64
    scale: int = 64
    seed: int = 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points along the Hilbert curve, as rows of bytes that sort like the places.

    ``cells`` has one row of coordinates below 2^bits per point. Axes are turned and swapped level by
    level, for all points at once, and the Gray code of the result is undone.
    """
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for axis in x:
            set_ = (axis & level) != 0
            swap = np.where(set_, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(set_, low, swap)
            axis ^= swap
        level >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    level = top
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _stored(numbers: np.ndarray) -> str:
    """The smallest type that holds whole numbers given as doubles."""
    least, most = numbers.min(initial=0), numbers.max(initial=0)
    for kind in ("<i1", "<i2", "<i4"):
        held = np.iinfo(kind)
        if held.min <= least and most <= held.max:
            return kind
    return "<f8"


def _exact(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers."""
    return np.array([int(v) for v in numbers.ravel()], dtype=object).reshape(numbers.shape)


def _columns(numbers: pa.ListArray) -> np.ndarray:
    width = len(numbers[0]) if len(numbers) else 1
    return np.floor(numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be the nearest of a point of the box.

    First those go whose distance to the box is above another one's distance to its farthest point. The
    rest are held against the one nearest to the middle of the box: the difference of two squared
    distances is linear in the point, so its extreme over a box is exact, and a centroid that is farther
    at every point of the box goes as well.
    """
    beside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    across = np.maximum(centroids - low, high - centroids)
    bounded = np.flatnonzero((beside * beside).sum(axis=1) <= (across * across).sum(axis=1).min())
    left = centroids[bounded]
    middle = 2 * left - low - high
    best = left[(middle * middle).sum(axis=1).argmin()]
    slope = 2 * (left - best)
    most = np.maximum(slope * low, slope * high).sum(axis=1) + (best * best).sum() - (left * left).sum(axis=1)
    return bounded[most >= 0]


def nearest(block: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Nearest centroid of each vector, the squared distance to it, and whether doubles were enough."""
    narrow = max(-low.min(), high.max(), max(abs(v) for c in centroids for v in c)) <= NARROW and block.shape[1] <= 64
    if narrow:
        points, ends, middles = block.astype(np.float64), (low, high), np.array(centroids, dtype=np.float64)
    else:
        points, ends, middles = _exact(block), (_exact(low), _exact(high)), np.array(centroids, dtype=object)
    kept = candidates(*ends, middles)
    if narrow:
        middles = middles[kept]
        squares = (points * points).sum(axis=1)[:, None] - 2 * (points @ middles.T) + (middles * middles).sum(axis=1)
    else:
        squares = np.stack([((points - middles[k]) ** 2).sum(axis=1) for k in kept], axis=1)
    place = squares.argmin(axis=1)
    return kept[place], squares[np.arange(len(place)), place], narrow


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    kinds, lows, highs, cells = (batch.column(name).to_pylist() for name in ("kind", "low", "high", "cells"))
    ids = batch.column("ids")
    for row, kind in enumerate(kinds):
        low, high = (np.frombuffer(end[row], dtype=kind).astype(np.float64) for end in (lows, highs))
        yield np.frombuffer(cells[row], dtype=kind).reshape(-1, len(low)).astype(np.float64), low, high, ids[row].values


def _limbs(total: int) -> Iterator[int]:
    """Parts of a whole number, the lowest first; all but the last are not negative."""
    while not -1 <= total <= 0:
        yield total & ((1 << LIMB) - 1)
        total >>= LIMB
    if total:
        yield total


def _keyed(edges: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their place on the curve; ``edges`` cut each component into cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = _columns(batch.column("numbers"))
            cells = (numbers[:, :, None] >= edges.T[None, :, :]).sum(axis=2)
            keys, kind = hilbert_keys(cells, CURVE_BITS), _stored(numbers)
            held = numbers.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                    batch.column("salt"),
                    pa.array([kind] * len(keys), pa.string()),
                    pa.array([v.tobytes() for v in held], pa.binary()),
                ],
                names=["id", "place", "salt", "kind", "cells"],
            )

    return run


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbours with their boxes."""
    for batch in batches:
        kinds, cells, ids = batch.column("kind").to_pylist(), batch.column("cells").to_pylist(), batch.column("id")
        rows: list[tuple] = []
        parts = []
        for first in range(0, batch.num_rows, BLOCK):
            last = min(first + BLOCK, batch.num_rows)
            held = np.stack([np.frombuffer(cells[i], dtype=kinds[i]).astype(np.float64) for i in range(first, last)])
            kind = _stored(held)
            ends = (held.min(axis=0), held.max(axis=0), held)
            rows.append((kind, *[e.astype(kind).tobytes() for e in ends]))
            parts.append(last - first)
        if rows:
            offsets = pa.array(np.concatenate([[0], np.cumsum(parts)]), pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, ids)]
            columns += [pa.array([r[0] for r in rows], pa.string())]
            columns += [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "kind", "low", "high", "cells"])


def _round(centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums per cluster and component of a task's vectors; component -1 is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, width = len(centroids), len(centroids[0])
        totals = np.zeros((count, width + 1), dtype=object)
        for batch in batches:
            for block, low, high, _ in _blocks(batch):
                cluster, _, narrow = nearest(block, low, high, centroids)
                held = block if narrow else _exact(block)
                for k in np.unique(cluster).tolist():
                    own = held[cluster == k]
                    totals[k, 0] += len(own)
                    totals[k, 1:] += _exact(own.sum(axis=0))
        rows = [(k, c - 1, limb, part) for k in range(count) for c in range(width + 1) for limb, part in enumerate(_limbs(int(totals[k, c])))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "limb", "total"])

    return run


def _assigned(centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, low, high, ids in _blocks(batch):
                cluster, distance, _ = nearest(block, low, high, centroids)
                columns = [ids, pa.array(cluster, pa.int32()), pa.array([min(int(d), LARGEST) for d in distance], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return run


def kept_vectors(df: DataFrame, key: str, vector: str, plan: Plan) -> DataFrame:
    """``id`` and ``numbers`` (multiplied, not floored) of the vectors that count."""
    numbers = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(plan.scale)))
    finite = F.forall("numbers", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    return df.select(F.col(key).alias("id"), numbers.alias("numbers")).where((F.size("numbers") == plan.components) & finite)


def starting_centroids(vectors: DataFrame, plan: Plan) -> list[list[int]]:
    place = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.withColumn("place", place).orderBy(F.asc_nulls_last("place"), "numbers").limit(plan.clusters)
    return [[math.floor(x) for x in row["numbers"]] for row in first.select("numbers").collect()]


def vector_blocks(vectors: DataFrame, starts: list[list[int]]) -> DataFrame:
    """Blocks of neighbours, written: ``ids``, and ``low``, ``high`` and ``cells`` as numbers of type ``kind``.

    The cells of the curve are cut at quantiles of the starts, a sample that the hashes have drawn.
    """
    cuts = [k / (1 << CURVE_BITS) for k in range(1, 1 << CURVE_BITS)]
    edges = np.quantile(np.array(starts, dtype=np.float64), cuts, axis=0)
    kind = vectors.schema["id"].dataType.simpleString()
    salted = shipped(vectors).withColumn("salt", F.rand(7))
    keyed = salted.mapInArrow(_keyed(edges), f"id {kind}, place binary, salt double, kind string, cells binary")
    keyed = staged(keyed, "vector-places")
    near = keyed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    blocks = near.mapInArrow(_boxed, f"ids array<{kind}>, kind string, low binary, high binary, cells binary")
    return staged(blocks, "vector-blocks")


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of the vectors nearest to each centroid; a centroid without any stays."""
    sums = blocks.mapInArrow(_round(centroids), ROUND_SCHEMA).groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals: dict[tuple[int, int], int] = {}
    # At most clusters x components x a few limbs, whatever the number of vectors.
    for cluster, component, limb, total in sums.collect():
        totals[cluster, component] = totals.get((cluster, component), 0) + (int(total) << (LIMB * limb))
    out = []
    for k, old in enumerate(centroids):
        size = totals.get((k, -1), 0)
        out.append([totals.get((k, c), 0) // size for c in range(len(old))] if size else old)
    return out


def centroid_digest(centroid: list[int]) -> Column:
    return F.sha2(F.lit(",".join(map(str, centroid))).cast("binary"), 256)


def centroid_clusters(df: DataFrame, plan: Plan = Plan(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per kept vector its id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``."""
    vectors = kept_vectors(df, key, vector, plan)
    centroids = starting_centroids(vectors, plan)
    if not centroids:
        nothing = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return vectors.where("false").select(F.col("id").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    blocks = vector_blocks(vectors, centroids)
    for _ in range(plan.rounds):
        centroids = moved(blocks, centroids)
    kind = vectors.schema["id"].dataType.simpleString()
    nearest_of = staged(blocks.mapInArrow(_assigned(centroids), f"id {kind}, cluster int, distance bigint"), "vector-clusters")
    sums = nearest_of.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    inertia = {row["cluster"]: int(row["sum"]) for row in sums.collect()}
    by_cluster = F.array(*[F.lit(min(inertia.get(k, 0), LARGEST)) for k in range(len(centroids))]).cast("array<bigint>")
    digests = F.array(*[centroid_digest(c) for c in centroids])
    return nearest_of.select(
        F.col("id").alias(key),
        "cluster",
        "distance",
        F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LARGEST)).cast("bigint").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
