"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance by vantage-point trees.

Equal fingerprints are one point. Over whole fingerprints half of all points lie within two bits of a sphere that halves
them, so copies of boundary points would grow with every level. Fingerprints are therefore cut into blocks of bits, one
more than the reach: of two that differ in at most ``reach`` bits some block is equal, in general some block differs in
at most ``reach // blocks``. Each block has a vantage-point tree over its own Hamming distance. Its upper levels, fitted
on a bounded sample, deal all points to shards: a point goes to the side of each vantage point on which it lies, and as a
query to every later shard that its ball overlaps by the triangle inequality (with as many blocks as by default the ball
is the point itself and overlaps none). Every pair within the distance meets in a shard of some block; rows are the points
times the blocks, however deep the trees are. Within a shard a tree over whole fingerprints is walked by points and
queries together. A shard returns a spanning forest of its links, not the pairs, so a large group of near copies costs a
row each; forests are merged by connected components over shard roots.

Defined results: null and empty texts have fingerprint zero and are linked like any other. Repeated rows keep one
fingerprint and component. Rows with a null doc_id keep a null component_id unless another document shares it. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, texts
from .components import connected_components
from .hashing import mix
from .near_copies import keyed_rows, one_of_each

#: Points of a pair of sides that are compared outright.
LEAF_PAIRS = 1 << 20


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The fingerprint of UTF-8 text, as a signed 64-bit number."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z alone are lowered, and the words end at space and U+0009 to U+000D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[part : part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bit_blocks(blocks: int) -> np.ndarray:
    """Masks that cut 64 bits into so many blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return np.array([(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])], np.uint64)


def fit_levels(sample: np.ndarray, depth: int, candidates: int = 16) -> list[tuple[np.uint64, int]]:
    """A vantage point and radius for each level of a complete binary tree over the (masked) sample.

    Of the candidates, spread over the sample, the one is taken whose sphere comes nearest to halving the sample and is
    least correlated with the spheres above it, so that shards have like sizes."""
    levels: list[tuple[np.uint64, int]] = []
    above = np.zeros((0, len(sample)), np.float32)
    for level in range(depth):
        best = (np.inf, np.uint64(0), 0)
        for k in range(candidates):
            v = sample[(level * candidates + k) * 7919 % len(sample)]
            d = distance(sample, v).astype(np.int64)
            for radius in {int(np.median(d)), int(np.median(d)) - 1}:
                side = np.where(d > radius, np.float32(1), np.float32(-1))
                best = min(best, (float(((above @ side / len(side)) ** 2).sum() + side.mean() ** 2), v, radius), key=lambda x: x[0])
        levels.append(best[1:])
        above = np.vstack([above, np.where(distance(sample, best[1]) > best[2], np.float32(1), np.float32(-1))])
    return levels


def deal(fps: np.ndarray, levels: list[tuple[np.uint64, int]], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (which point, shard, is query): each point at home, and as a query in later shards that its ball overlaps."""
    who, shard, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    for v, radius in levels:
        d = distance(fps[who], v).astype(np.int64)
        inside = d <= radius
        low, high = d <= radius + reach, d > radius - reach
        if not reach:
            shard = shard * 2 + ~inside
            continue
        who, home, shard = np.concatenate([who[low], who[high]]), np.concatenate([(home & inside)[low], (home & ~inside)[high]]), np.concatenate([2 * shard[low], 2 * shard[high] + 1])
    own = np.zeros(len(fps), np.int64)
    own[who[home]] = shard[home]
    later = shard >= own[who]
    return who[later], shard[later], ~home[later]


def shard_of(leaf: np.ndarray, depth: int) -> np.ndarray:
    """One of 2**depth shards for each leaf."""
    return (mix(leaf.astype(np.uint64)) >> np.uint64(1) & np.uint64((1 << depth) - 1)).astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def roots(self) -> np.ndarray:
        """The root of every member; also shortens all paths."""
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[k] and b[k]; pairs of roots that recur are linked once."""
        up = self.roots()
        a, b = up[a], up[b]
        pairs = np.unique(np.minimum(a, b) * len(up) + np.maximum(a, b))
        for x, y in zip((pairs // len(up)).tolist(), (pairs % len(up)).tolist()):
            x, y = self.root(x), self.root(y)
            self.up[max(x, y)] = min(x, y)


def link_shard(fps: np.ndarray, query: np.ndarray, reach: int) -> np.ndarray:
    """The root (a position) of each row of a shard, rows linked if within reach and not both queries."""
    forest = _Forest(len(fps))

    def compare(points: np.ndarray, others: np.ndarray) -> None:
        step = max(1, LEAF_PAIRS // max(1, len(points)))
        for k in range(0, len(others), step):
            part = others[k : k + step]
            a, b = np.nonzero(distance(fps[part][:, None], fps[points][None, :]) <= reach)
            a, b = part[a], points[b]
            new = a != b
            forest.link(a[new], b[new])

    # Points (at home here) against points and queries; both sides go down the tree together.
    stack = [(np.flatnonzero(~query), np.arange(len(fps)))]
    while stack:
        points, others = stack.pop()
        if not len(points) or not len(others):
            continue
        if len(points) * len(others) <= LEAF_PAIRS:
            compare(points, others)
            continue
        v = fps[points[len(points) // 2]]
        d, e = distance(fps[points], v).astype(np.int64), distance(fps[others], v).astype(np.int64)
        radius = int(np.median(d))
        radius -= radius == d.max()
        inner = (points[d <= radius], others[e <= radius + reach])
        outer = (points[d > radius], others[e > radius - reach])
        if len(inner[0]) * len(inner[1]) + len(outer[0]) * len(outer[1]) > 0.9 * len(points) * len(others):
            compare(points, others)  # too dense to split
        else:
            stack += [inner, outer]
    return forest.roots()


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2, sample: int = 16384, shard_points: int = 2000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document; shard_points is the aim for points at home in a shard."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_points))))
    chosen = points.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect() if depth else []
    chosen = np.array([r["fp"] for r in chosen], np.int64).view(np.uint64)
    masks = bit_blocks(reach + 1)
    # Leaves differ in size; a shard is some 64 leaves, so that shards don't.
    trees = [fit_levels(chosen & mask, depth + 6 if depth else 0) for mask in masks]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for k, mask in enumerate(masks):
                who, leaf, query = deal(fps.view(np.uint64) & mask, trees[k], reach // len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(leaf, depth) * len(masks) + k), pa.array(fps[who]), pa.array(query)], ["shard", "fp", "query"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        fps = pdf["fp"].to_numpy()
        roots = link_shard(fps.view(np.uint64), pdf["query"].to_numpy(), reach)
        linked = np.bincount(roots, minlength=len(roots))[roots] > 1
        return pd.DataFrame({"fp": fps[linked], "root": fps[roots[linked]]})

    dealt = points.select("fp").mapInArrow(shards, "shard long, fp long, query boolean")
    forest = materialize(dealt.groupBy("shard").applyInPandas(link, "fp long, root long"), "forest")
    # A point that several shards have linked joins their roots; only such pairs of roots are a graph.
    least = materialize(forest.groupBy("fp").agg(F.min("root").alias("b"), F.max("root").alias("c")).filter("b < c").select("fp", "b"), "meetings")
    meetings = forest.join(least, "fp").filter("root <> b").select(F.col("root").alias("a"), "b").distinct()
    labels = connected_components(meetings)
    rooted = forest.groupBy("fp").agg(F.min("root").alias("node"))
    rooted = materialize(rooted.join(labels, "node", "left").select("fp", F.coalesce("root", "node").alias("root")), "rooted")
    named = points.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = materialize(named.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """The row with the smallest doc_id of each component, all columns as they are; rows with one doc_id, or none, and different texts are told apart."""
    keyed = keyed_rows(docs)
    found = near_duplicates(keyed.select(F.col("__row_key").alias("doc_id"), "text"), shingle, reach)
    return one_of_each(keyed, found.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("component")))
