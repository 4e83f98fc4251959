"""Centroid clustering of integer vectors, filtered by ball trees.

Each task builds metric trees over its own vectors, a tree for every block of ``BLOCK`` vectors, and writes them once: a
node is a ball with a centre, a radius, a count and the exact integer sum of its vectors. A round walks all trees of a task
level by level with the centroids that can still be nearest to some vector of a ball: where d is the distance to the
centre, a centroid with d - radius > least d + radius is out by the triangle inequality. A ball with one centroid left is
assigned whole by its count and sum; other balls descend, and at leaves the remaining centroids are compared by exact
integer distances. Bounds carry a margin far above rounding errors, so ties and near ties always reach the exact leaves.
Only sums and counts of clusters leave a task, and the driver sees the totals of ``k`` centroids.

Integers of up to 2**21 are computed in doubles, where every product and sum is below 2**53 and so exact. A block with
larger ones has no tree: its vectors are compared in Python's integers. Sums travel as four limbs of 40 bits.

Defined results: vectors of another length, with nulls or non-finite components are left out, as are null ones. Repeated
rows are clustered one by one. Equal hashes (repeated or null vec_ids) are ordered by components. Fewer vectors than k
give as many centroids. Squared distances, and sums of them, beyond a long are null. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

BLOCK, LEAF = 8192, 24
#: Components of at most this size are exact in doubles.
SMALL = 1 << 21
TREES = "ids binary, known binary, points binary, exact boolean, lo array<int>, hi array<int>, left array<int>, centre binary, radius array<double>, total binary"
SUMS = "cluster int, limb int, component int, total long"
LIMB, LIMBS = 40, 4
LONG = 2**63 - 1


def floors(raw: np.ndarray) -> np.ndarray:
    """floor(256 * x): doubles where they are exact, Python integers else."""
    x = np.floor(raw.astype(np.float64) * 256)
    if not x.size or np.abs(x).max() <= SMALL:
        return x
    return np.array([[int(e) for e in row] for row in x], object)


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the vectors, and nodes over ranges [lo, hi) of it; the children of a node are left and left + 1, or -1.

    A ball is parted at the median along the line between a far point and the point farthest from it. Equal vectors are a
    leaf of radius 0, however many they are."""
    order, nodes, k = np.arange(len(x)), [(0, len(x))], 0
    left, centre, radius, total = [], [], [], []
    while k < len(nodes):
        lo, hi = nodes[k]
        part = x[order[lo:hi]]
        total.append(part.sum(0))
        centre.append(total[-1] / (hi - lo))
        far = ((part - centre[-1]) ** 2).sum(1)
        radius.append(float(np.sqrt(far.max())) if (part != part[0]).any() else 0.0)
        if hi - lo > LEAF and radius[-1]:
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(1).argmax()]
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part @ (b - a), middle)]
            left.append(len(nodes))
            nodes += [(lo, lo + middle), (lo + middle, hi)]
        else:
            left.append(-1)
        k += 1
    spans = np.array(nodes, np.int32)
    return order, {"lo": spans[:, 0], "hi": spans[:, 1], "left": np.array(left, np.int32), "centre": np.array(centre), "radius": np.array(radius), "total": np.array(total)}


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equals, and the squared distance; exact."""
    if x.dtype == object:
        d = np.array([[sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids.tolist()] for row in x.tolist()], object).reshape(len(x), len(centroids))
        best = np.array([min(range(len(row)), key=row.__getitem__) for row in d.tolist()], np.int64)
    else:
        d = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)
        best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def walk(x: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Balls assigned whole, as (nodes, centroids), and vectors assigned at leaves, as (vectors, centroids)."""
    k = len(centroids)
    norms = (centroids * centroids).sum(1)
    margin = 1e-6 * (1 + np.sqrt(norms.max()) + np.abs(tree["centre"]).max() * np.sqrt(x.shape[1]))
    front, alive = np.array([0]), np.ones((1, k), bool)
    balls, points = [], []
    while len(front):
        c = tree["centre"][front]
        d = np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * (c @ centroids.T) + norms, 0))
        d[~alive] = np.inf
        r = tree["radius"][front]
        alive = d - r[:, None] <= (d.min(1) + r + margin)[:, None]
        one = alive.sum(1) == 1
        balls.append((front[one], alive[one].argmax(1)))
        leaf = ~one & (tree["left"][front] < 0)
        for node, can in zip(front[leaf], alive[leaf]):
            some = np.flatnonzero(can)
            rows = np.arange(tree["lo"][node], tree["hi"][node])
            if tree["radius"][node]:
                points.append((rows, some[nearest(x[rows], centroids[some])[0]]))
            else:
                points.append((rows, np.full(len(rows), some[nearest(x[rows[:1]], centroids[some])[0][0]])))
        down = ~one & ~leaf
        front, alive = np.concatenate([tree["left"][front[down]], tree["left"][front[down]] + 1]), np.concatenate([alive[down], alive[down]])
    return balls, points


def plant(dims: int):
    """Rows of trees from rows of vectors."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, BLOCK - n)
                held.append(part)
                at, n = at + len(part), n + len(part)
                if n == BLOCK:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["vec_id"].combine_chunks()
        raw = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        known, ids, x = np.array(ids.is_valid()), np.asarray(ids.fill_null(0)), floors(raw)
        if x.dtype == object:  # kept as given: floors() gives the integers again
            out = {"ids": ids.tobytes(), "known": known.tobytes(), "points": raw.astype("<f8").tobytes(), "exact": False} | dict.fromkeys(("lo", "hi", "left", "centre", "radius", "total"))
        else:
            order, tree = ball_tree(x)
            out = {"ids": ids[order].tobytes(), "known": known[order].tobytes(), "points": x[order].astype("<i4").tobytes(), "exact": True, "centre": tree["centre"].tobytes(), "total": tree["total"].astype("<i8").tobytes()}
            out |= {c: tree[c].tolist() for c in ("lo", "hi", "left", "radius")}
        kinds = {"binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
        return pa.RecordBatch.from_arrays([pa.array([out[c]], kinds[t]) for c, t in (f.split(" ") for f in TREES.split(", "))], [f.split(" ")[0] for f in TREES.split(", ")])

    return build


def trees_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[dict, np.ndarray, dict | None]]:
    """Each row of a batch of trees: the row, its vectors, its nodes (None for a block with large components)."""
    for batch in batches:
        for row in batch.to_pylist():
            if not row["exact"]:
                yield row, floors(np.frombuffer(row["points"], "<f8").reshape(-1, dims)), None
                continue
            tree = {c: np.array(row[c], np.int32) for c in ("lo", "hi", "left")} | {"radius": np.array(row["radius"])}
            tree |= {"centre": np.frombuffer(row["centre"]).reshape(-1, dims), "total": np.frombuffer(row["total"], "<i8").reshape(-1, dims)}
            yield row, np.frombuffer(row["points"], "<i4").reshape(-1, dims).astype(np.float64), tree


def usable(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The centroids as Python integers and, where they are small, as doubles."""
    exact = np.array(centroids, object)
    return exact, exact.astype(np.float64) if max(abs(e) for c in centroids for e in c) <= SMALL else None


def by_cluster(centroids: list[list[int]], dims: int):
    """Counts (component -1) and sums of each cluster, in limbs, from rows of trees."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, plain = usable(centroids)
        sums = np.zeros((len(centroids), dims + 1), object)
        for _, x, tree in trees_of(batches, dims):
            if tree is None or plain is None:
                rows = np.array([[int(e) for e in row] for row in x.tolist()], object).reshape(len(x), dims)
                for c, row in zip(nearest(rows, exact)[0], rows):
                    sums[c, :dims] += row
                    sums[c, dims] += 1
                continue
            own = np.zeros((len(centroids), dims + 1), np.int64)  # at most 2**21 * BLOCK
            balls, points = walk(x, tree, plain)
            for nodes, best in balls:
                np.add.at(own[:, :dims], best, tree["total"][nodes])
                np.add.at(own[:, dims], best, tree["hi"][nodes] - tree["lo"][nodes])
            for rows, best in points:
                np.add.at(own[:, :dims], best, x[rows].astype(np.int64))
                np.add.at(own[:, dims], best, 1)
            sums += own
        out = [(c, k, i, v >> LIMB * k if k == LIMBS - 1 else (v >> LIMB * k) & ((1 << LIMB) - 1)) for c, row in enumerate(sums.tolist()) if row[dims] for i, v in enumerate(row) for k in range(LIMBS)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "limb", "component", "total"])

    return add


def by_vector(centroids: list[list[int]], dims: int):
    """vec_id, cluster and squared distance of each vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, plain = usable(centroids)
        for row, x, tree in trees_of(batches, dims):
            if tree is None or plain is None:
                rows = np.array([[int(e) for e in v] for v in x.tolist()], object).reshape(len(x), dims)
                cluster, distance = nearest(rows, exact)
                distance = [None if d > LONG else d for d in distance.tolist()]
            else:
                cluster = np.empty(len(x), np.int64)
                balls, points = walk(x, tree, plain)
                for nodes, best in balls:
                    for node, c in zip(nodes, best):
                        cluster[tree["lo"][node] : tree["hi"][node]] = c
                for rows, best in points:
                    cluster[rows] = best
                distance = ((x - plain[cluster]) ** 2).sum(1).astype(np.int64)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return assign


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return [[int(e) for e in floors(np.array([r["embedding"]]))[0]] for r in found]


def centroid_clusters(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    e = F.col("embedding").cast("array<double>")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    vectors = rows.select("vec_id", e.alias("embedding")).where((F.size("embedding") == dims) & finite)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = materialize(vectors.mapInArrow(plant(dims), TREES), "ball-trees")
    for _ in range(rounds):
        found: dict[tuple[int, int], int] = {}
        for r in trees.mapInArrow(by_cluster(centroids, dims), SUMS).groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total")).collect():
            at = r["cluster"], r["component"]
            found[at] = found.get(at, 0) + (r["total"] << LIMB * r["limb"])
        centroids = [[found[c, i] // found[c, dims] for i in range(dims)] if (c, dims) in found else old for c, old in enumerate(centroids)]
    assigned = materialize(trees.mapInArrow(by_vector(centroids, dims), "vec_id long, cluster int, distance long"), "clusters")
    discard(trees)
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(whole.alias("inertia")).collect()}  # k numbers
    total = None if None in sums.values() else sum(map(int, sums.values()))
    own = [(c, fits(sums[c]), fits(total), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids) if c in sums]
    of_cluster = rows.sparkSession.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def fits(total) -> int | None:
    return None if total is None or total > LONG else int(total)
