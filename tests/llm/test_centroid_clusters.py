"""Clusters against plain whole-number arithmetic, keys against the curve's own property."""

import hashlib
import math
import random

import numpy as np

from tablewarden.llm.centroid_clusters import LARGEST, Plan, candidates, centroid_clusters, hilbert_keys, kept_vectors, nearest, starting_centroids, vector_blocks
from tablewarden.llm.queries import op11_centroids

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, plan=Plan()):
    def whole(x):
        return math.floor(plan.scale * x)

    held = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == plan.components and all(x is not None and math.isfinite(x) for x in v)]
    place = {i: "~" if i is None else hashlib.sha256(f"{plan.seed}:{i}".encode()).hexdigest() for i, _ in held}
    centroids = [v for _, v in sorted(held, key=lambda r: (place[r[0]], r[1]))[: plan.clusters]]

    def assigned():
        out = []
        for _, v in held:
            squares = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((squares.index(min(squares)), min(squares)))
        return out

    for _ in range(plan.rounds):
        found = assigned()
        for k in range(len(centroids)):
            own = [v for (_, v), (g, _) in zip(held, found) if g == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    found = assigned()
    sums = [sum(d for g, d in found if g == k) for k in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cut = lambda n: min(n, LARGEST)
    return sorted(((i, g, cut(d), cut(sums[g]), cut(sum(sums)), digests[g]) for (i, _), (g, d) in zip(held, found)), key=repr)


def check(df, plan=Plan()):
    got = sorted((tuple(r) for r in centroid_clusters(df, plan).collect()), key=repr)
    assert got == expected([(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()], plan)
    return got


def vectors(count, seed, spread=1.0, centres=5):
    r = random.Random(seed)
    middles = [[r.uniform(-4, 4) for _ in range(64)] for _ in range(centres)]
    return [[m + r.gauss(0, spread) for m in r.choice(middles)] for _ in range(count)]


def test_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = sorted((tuple(r) for r in op11_centroids(spark, SMALL).collect()), key=repr)
    assert got == expected([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_hard_rows(spark):
    good = vectors(40, 3)
    rows = [(i, v, 0) for i, v in enumerate(good)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [0.0] * 63, [float("-inf")] + [0.0] * 63]
    rows += [(100 + i, v, None) for i, v in enumerate(bad)]
    # No id, equal rows, equal ids, ties between two centroids.
    rows += [(None, good[0], 1), (None, good[1], 1), rows[5], rows[5], (7, good[9], 0), (200, [0.0] * 64, 0), (201, [-0.01] * 64, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(check(df)) == 47
    clashing = df
    for name in ("id", "cluster", "distance", "place", "salt", "cells", "numbers"):
        clashing = clashing.selectExpr("*", f"'clash' AS {name}")
    assert len(check(clashing)) == 47


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64, 0), (2, [-0.5] * 64, 0)], SCHEMA)
    assert [r[1:3] for r in check(df)] in ([(0, 0), (1, 0)], [(1, 0), (0, 0)])
    for empty in (df.where("false"), spark.createDataFrame([(1, None, 0)], SCHEMA)):
        out = centroid_clusters(empty)
        assert out.collect() == []
        assert out.dtypes == centroid_clusters(df).dtypes


def test_very_large_components(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.choice([0, 3, 7, 12]) for _ in range(64)], 0) for i in range(60)]
    rows += [(100, [3e38] * 64, 0), (101, [-3e38] + [1.0] * 63, 0)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_copies_and_partitioning(spark):
    rows = [(i, [0.25] * 64, 0) for i in range(700)] + [(1000 + i, v, 0) for i, v in enumerate(vectors(500, 8))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert check(df.repartition(1)) == check(df.repartition(7, "vec_id"))
    # Copies are spread over the partitions, not held by one block.
    held = vector_blocks(found := kept_vectors(df, "vec_id", "embedding", Plan()), starting_centroids(found, Plan()))
    assert max(len(b["ids"]) for b in held.collect()) <= 64


def test_other_plans(spark):
    df = spark.createDataFrame([(i, v[:5], 0) for i, v in enumerate(vectors(200, 9))], SCHEMA)
    check(df, Plan(clusters=7, rounds=5, components=5, scale=100, seed=3))


def test_curve_visits_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 2), (5, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        keys = [bytes(k) for k in hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(grid)
        path = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_prune_and_lose_nothing():
    r = np.random.default_rng(2)
    kept = []
    for _ in range(50):
        middle = r.integers(-300, 300, 64)
        block = (middle + r.integers(-20, 20, (64, 64))).astype(np.float64)
        centroids = [[int(x) for x in c] for c in r.integers(-300, 300, (15, 64))] + [[int(x) for x in middle]]
        low, high = block.min(axis=0), block.max(axis=0)
        kept.append(len(candidates(low, high, np.array(centroids, dtype=float))))
        cluster, distance, narrow = nearest(block, low, high, centroids)
        squares = ((block[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
        assert narrow and (cluster == squares.argmin(axis=1)).all() and (distance == squares.min(axis=1)).all()
    assert np.mean(kept) < 3
