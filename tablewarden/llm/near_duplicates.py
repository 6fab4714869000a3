"""Near duplicates by b-bit MinHash.

1. Texts with the same words in the same order are one class; the rest works on one text a class.
2. Each class gets minima of 128 hash functions over its shingles. Groups of minima make bands, and the
   low bits of all minima are packed into a signature.
3. Classes that agree in a band are candidates. A pair goes on if the similarity estimated from equal
   low bits, corrected for chance agreement, is not far below the threshold.
4. Links are confirmed on the full shingle sets, and connected components are found.

A band's bucket is never paired off as a whole. In a round every member is compared with one member
drawn per bucket; members whose component differs from that of others in their bucket go on to the
next round with another draw. What is left after the last draw is compared exhaustively, across
components only: small buckets as pairs, large ones in blocks of bounded size, the members outside the
bucket's main component against all. A block compares its sets in memory and passes on only as many
links as it takes to join the components it saw. Buckets of copies thus cost one pair per member, and
no link that the bands let through is lost.

Recall: a pair at similarity 0.75 misses all bands with probability (1 - 0.75^4)^32 < 1e-5, and the
estimate's margin is five standard deviations.

Defined cases: A-Z are a-z; a text with fewer than five words has one shingle, its whole sequence; a
text without words (or null) has none and is alone; rows with a null id are linked like others and take
part in components with the smallest id that is not null; repeated rows are in one class; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import remove_scratch
from .components import components
from .tables import shipped, staged
from .texts import mixed, shingles, slices, words


@dataclass(frozen=True)
class Near:
    """A similarity in hundredths; ``bands`` times ``rows`` hash functions; ``bits`` of each are kept."""

    similarity: int = 75
    shingle: int = 5
    bands: int = 32
    rows: int = 4
    bits: int = 4
    margin: float = 0.2
    draws: int = 1
    small_bucket: int = 48
    block: int = 512
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def packed(self) -> int:
        """Signature words of 64 bits."""
        return self.hashes * self.bits // 64


def _functions(near: Near) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(near.seed))
    factors = r.integers(0, 1 << 31, near.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors[:, None], r.integers(0, 1 << 32, near.hashes, dtype=np.uint32)[:, None]


def minima(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray, block: int = 1024) -> np.ndarray:
    """Of every hash function over the shingles of one text."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), block):
        np.minimum(out, (low[None, at : at + block] * factors + offsets).min(axis=1), out=out)
    return out


def _signatures(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _functions(near)
        turn = np.arange(1, near.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        band_no = np.arange(near.bands, dtype=np.uint64)
        places = (np.arange(64 // near.bits) * near.bits).astype(np.uint64)
        for batch in batches:
            digests, sizes, signatures, bands = [], [], [], []
            for part in slices(batch.column(1)):
                found = words(part)
                runs, bounds = shingles(found, near.shingle)
                for i in range(part.last - part.first):
                    own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    held = np.unique(runs[bounds[i] : bounds[i + 1]])
                    sizes.append(len(held))
                    if not len(held):
                        signatures.append(None)
                        bands.append(None)
                        continue
                    least = mixed(minima(held, factors, offsets).astype(np.uint64))
                    keys = mixed((least.reshape(near.bands, near.rows) * turn).sum(axis=1, dtype=np.uint64) + band_no)
                    kept = (least & np.uint64((1 << near.bits) - 1)).reshape(near.packed, -1)
                    signatures.append((kept << places).sum(axis=1, dtype=np.uint64).view(np.int64))
                    bands.append(keys.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, longs), pa.array(bands, longs)],
                names=["doc_id", "words_id", "n_shingles", "signature", "bands"],
            )

    return run


def _sets(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                found = words(part)
                runs, bounds = shingles(found, near.shingle)
                digests, sets = [], []
                for i in range(part.last - part.first):
                    own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sets.append(np.unique(runs[bounds[i] : bounds[i + 1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["words_id", "shingles"]
                )

    return run


def _joining(near: Near):
    """Of one block: links between its left and right members that join components not yet joined in it."""

    def run(block: pa.Table) -> pa.Table:
        nodes, parts = block["node"].to_numpy(), block["component"].to_numpy()
        is_left = block["left"].to_numpy(zero_copy_only=False)
        sets = block["shingles"].combine_chunks()
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        bounds, values = np.asarray(sets.offsets), sets.values.to_numpy()
        sizes = np.diff(bounds)
        right = np.flatnonzero(~is_left)
        held = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in right]) if len(right) else np.zeros(0, np.int64)
        owner = np.repeat(right, sizes[right])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        parent = {int(p): int(p) for p in parts}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for i in np.flatnonzero(is_left):
            own = values[bounds[i] : bounds[i + 1]]
            low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            runs = high - low
            at = np.repeat(low - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            shared = np.bincount(owner[at], minlength=len(nodes))
            for j in np.flatnonzero((shared > 0) & (100 * shared >= near.similarity * (sizes + sizes[i] - shared))):
                one, other = root(int(parts[i])), root(int(parts[j]))
                if one != other:
                    parent[one] = other
                    links.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """Of rows (id, text): ``doc_id``, ``words_id``, ``n_shingles``, ``signature``, ``bands``."""
    kind = docs.schema[0].dataType.simpleString()
    return shipped(docs).mapInArrow(
        _signatures(near), f"doc_id {kind}, words_id binary, n_shingles bigint, signature array<bigint>, bands array<bigint>"
    )


def estimate(left: Column, right: Column, near: Near) -> Column:
    """Similarity from packed low bits: equal groups of bits, less those that agree by chance."""
    low = sum(1 << at for at in range(0, 64, near.bits))
    mask = F.lit(low - (1 << 64) if low >= 1 << 63 else low)
    unequal = []
    for i in range(near.packed):
        differ = F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))
        folded = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftrightunsigned(differ, s) if s else differ for s in range(near.bits)])
        unequal.append(F.bit_count(folded.bitwiseAND(mask)))
    agree = 1 - reduce(add, unequal) / near.hashes
    chance = 2.0**-near.bits
    return (agree - chance) / (1 - chance)


class _Search:
    """The steps for one table of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, near: Near, made: list[str]):
        self.docs, self.classes, self.near, self.made = docs, classes, near, made
        self.sets = None

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        return staged(df, label, self.made)

    def buckets(self) -> DataFrame:
        """``bucket``, ``node``: bands that two classes or more agree in."""
        banded = self.classes.select("node", F.explode("bands").alias("bucket"))
        shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
        return self.staged(banded.join(shared, "bucket").select("bucket", "node"), "buckets")

    def drawn(self, buckets: DataFrame, labels: DataFrame | None, draw: int) -> DataFrame:
        """Pairs of a member and the one drawn from its bucket, across components."""
        members = self.labelled(buckets, labels)
        order = F.xxhash64("node", F.lit(draw))
        chosen = members.groupBy("bucket").agg(
            F.min(F.struct(order.alias("order"), "node", "component")).alias("one"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
        )
        chosen = chosen.where("least != most").select("bucket", F.col("one.node").alias("other"), F.col("one.component").alias("of"))
        pairs = members.join(chosen, "bucket").where("component != of")
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def crossing(self, buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Links in buckets whose components still differ."""
        parts = self.labelled(buckets, labels).groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        whole = parts.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main")
        )
        whole = whole.where("parts > 1").select("bucket", "size", F.col("main.n").alias("main_size"), F.col("main.component").alias("main"))
        open_ = self.staged(self.labelled(buckets, labels).join(whole, "bucket"), "members")
        large = open_.where(F.col("size") > self.near.small_bucket)
        pairs = self.staged(self.close(self.across(open_.where(F.col("size") <= self.near.small_bucket))), "pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
        sets = self.shingle_sets(nodes)
        return self.staged(self.similar(pairs, sets).union(self.in_blocks(large, sets)).distinct(), "confirmed")

    def in_blocks(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links that join components of large buckets: members outside the main component against all, block by block."""
        size = self.near.block
        outside, all_ = (F.ceil(F.col(n) / size).cast("int") for n in ("outside", "size"))
        members = members.withColumn("outside", F.col("size") - F.col("main_size"))
        place = F.xxhash64("node", F.lit(-1))
        left = members.where("component != main").select(
            "bucket", "node", "component", F.lit(True).alias("left"),
            F.pmod(place, outside).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("y"),
        )
        right = members.select(
            "bucket", "node", "component", F.lit(False).alias("left"),
            F.explode(F.sequence(F.lit(0), outside - 1)).alias("x"), F.pmod(place, all_).cast("int").alias("y"),
        )
        held = left.union(right).join(sets, "node").select("bucket", "x", "y", "node", "component", "left", "shingles")
        return shipped(held).groupBy("bucket", "x", "y").applyInArrow(_joining(self.near), "a bigint, b bigint")

    def across(self, open_: DataFrame) -> DataFrame:
        """Pairs of small buckets whose components differ."""
        signed = open_.join(self.classes.select("node", "signature"), "node")
        left, right = signed.alias("l"), signed.alias("r")
        close = estimate(F.col("l.signature"), F.col("r.signature"), self.near) >= self.near.similarity / 100 - self.near.margin
        pairs = left.join(right, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") < F.col("r.component")) & close)
        return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()

    def labelled(self, buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return buckets.withColumn("component", F.col("node"))
        return buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate is not far below the threshold."""
        signed = self.classes.select("node", "signature")
        both = pairs.join(signed.toDF("a", "left"), "a").join(signed.toDF("b", "right"), "b")
        return both.where(estimate(F.col("left"), F.col("right"), self.near) >= self.near.similarity / 100 - self.near.margin).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs that are similar on the full sets of their texts."""
        pairs = self.staged(pairs, "pairs")
        sets = self.shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return self.staged(self.similar(pairs, sets).distinct(), "confirmed")

    def shingle_sets(self, nodes: DataFrame) -> DataFrame:
        """``node`` and ``shingles`` of some classes, from one more pass over the texts."""
        wanted = self.staged(nodes.join(self.classes, "node").select("node", "doc_id", "words_id"), "wanted")
        # Sorted at every size of the corpus, as the wanted ids have no bound that would allow a broadcast.
        ids = wanted.select(F.col("doc_id").alias("id_")).hint("merge")
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi")
        sets = shipped(texts.select("text")).mapInArrow(_sets(self.near), "words_id binary, shingles array<bigint>")
        sets = sets.join(wanted.select("node", "words_id"), "words_id").select("node", "shingles")
        return self.staged(sets, "sets")

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
        shared = F.size(F.array_intersect("left", "right"))
        all_ = F.size("left") + F.size("right") - shared
        return both.where(100 * shared >= self.near.similarity * all_).select("a", "b")


def near_duplicates(
    df: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text", made: list[str] | None = None
) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (the row has the smallest id of its component).

    Paths of the tables that the rows are read from are added to ``made``; those of steps before are deleted.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = staged(signatures(docs, near), "signatures", made)
    classes = rows.where("n_shingles > 0").dropDuplicates(["words_id"]).select("doc_id", "words_id", "signature", "bands")
    steps: list[str] = []
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes", steps)
    search = _Search(docs, classes, near, steps)
    buckets = search.buckets()
    links, labels = None, None
    for draw in range(near.draws + 1):
        if draw < near.draws:
            found = search.confirmed(search.close(search.drawn(buckets, labels, draw)))
        else:
            found = search.crossing(buckets, labels)
        links = found if links is None else links.union(found)
        labels = components(links, steps)
    named = rows.where("n_shingles > 0").groupBy("words_id").agg(F.min("doc_id").alias("least_id"))
    placed = named.join(classes.select("words_id", "node"), "words_id").join(labels, "node", "left")
    placed = staged(placed.select("words_id", "least_id", F.coalesce("component", "node").alias("component")), "placed", made)
    remove_scratch(df.sparkSession, steps)
    groups = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = placed.join(groups, "component").select("words_id", "component_id")
    out = rows.join(of_class, "words_id", "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
