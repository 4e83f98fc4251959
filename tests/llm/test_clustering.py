"""Ball-tree clustering against plain integer arithmetic."""

import hashlib
import math

import numpy as np

from panelforge.llm import clustering
from panelforge.llm.clustering import LONG, ball_tree, centroid_clusters, walk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(e)) for e in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        best = [min((gap(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    fits = lambda x: x if x is not None and x <= LONG else None
    sums = {j: sum(d for d, b in best if b == j) for _, j in best}
    lost = {j for d, j in best if d > LONG}
    total = None if lost else sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, fits(d), None if j in lost else fits(sums[j]), fits(total), names[j]) for (i, _), (d, j) in zip(kept, best)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def clustered(n, seed=1, spread=0.05):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 0.5, (7, 64))
    return [(k, (centres[k % 7] + random.normal(0, spread, 64)).astype(np.float32).tolist(), k % 7) for k in range(n)]


def test_clusters_equal_plain_arithmetic(spark):
    rows = clustered(700) + clustered(300, 2, 0.4)
    assert got(centroid_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain_clusters(rows)


def test_awkward_vectors(spark):
    rows = clustered(60)
    rows += [(1000 + k, rows[0][1], 0) for k in range(200)] + [(7, rows[7][1], 0), (7, rows[8][1], 0), (None, rows[9][1], None)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [1.0] * 63, 0), (2003, [1.0] * 63 + [None], 0), (2004, [1.0] * 63 + [float("nan")], 0), (2005, [float("-inf")] + [1.0] * 63, 0)]
    rows += [(3000 + k, [float(k % 3 - 1) / 256 + 1e-9] * 64, 0) for k in range(50)]  # ties
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cluster", "'y' AS distance", "'z' AS inertia")
    assert got(centroid_clusters(df.repartition(4))) == plain_clusters(rows)


def test_large_components(spark):
    rows = clustered(30) + [(100 + k, [float(np.float32(k * 10.0**k))] * 64, 0) for k in range(36)]
    assert got(centroid_clusters(spark.createDataFrame(rows, SCHEMA).coalesce(1))) == plain_clusters(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = clustered(5)
    assert got(centroid_clusters(spark.createDataFrame(rows, SCHEMA))) == plain_clusters(rows)
    assert centroid_clusters(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 50)
    rows = clustered(333)
    assert got(centroid_clusters(spark.createDataFrame(rows, SCHEMA).coalesce(2), k=9)) == plain_clusters(rows, 9)


def test_balls_hold_their_vectors_and_whole_balls_are_assigned():
    x = np.floor(256 * np.array([v for _, v, _ in clustered(3000)]))
    order, tree = ball_tree(x)
    assert sorted(order) == list(range(3000))
    for lo, hi, centre, radius, total in zip(tree["lo"], tree["hi"], tree["centre"], tree["radius"], tree["total"]):
        part = x[order[lo:hi]]
        assert (np.sqrt(((part - centre) ** 2).sum(1)) <= radius + 1e-9).all() and (part.sum(0) == total).all()
    y = x[order]
    centroids = y[[0, 500, 1000, 1500, 2000, 2500]]
    balls, points = walk(y, tree, centroids)
    cluster = np.full(3000, -1)
    for nodes, best in balls:
        for node, c in zip(nodes, best):
            assert (cluster[tree["lo"][node] : tree["hi"][node]] == -1).all()
            cluster[tree["lo"][node] : tree["hi"][node]] = c
    whole = (cluster >= 0).sum()
    for rows, best in points:
        assert (cluster[rows] == -1).all()
        cluster[rows] = best
    assert (cluster == ((y[:, None] - centroids) ** 2).sum(2).argmin(1)).all() and whole > 1000
