"""Dual-tree clustering against a plain Lloyd."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import clusters


def plain(rows, k=40, rounds=5, dims=64, scale=256, salt="2"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    each = {n: sum(d for d, m in last if m == n) for _, n in last}
    return sorted((i, n, d, each[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True))


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_clustering_is_the_plain_one(spark):
    """Crowded, tied, repeated and equal vectors, and those that take no part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=4) * 0.1).tolist()) for i in range(600)]
    rows += [(1000 + i, [float(i % 3), 0.0, 1.0, 0.0]) for i in range(90)] + [(2000, [0.5] * 4)] * 3
    rows += [(None, [0.0] * 4), (3000, None), (3001, [1.0] * 3), (3002, [1.0, None, 1.0, 1.0]), (3003, [1.0, math.nan, 1.0, 1.0]), (3004, [1.0, math.inf, 1.0, 1.0]), (3005, [-1e-300, 1e6, -1e6, 0.0]), (3006, [])]
    for k, size in ((7, 64), (40, 1024), (1, 100)):
        stored = clusters.blocks
        try:
            clusters.blocks = lambda *a, size=size: stored(*a, size=size)
            got, _ = clusters.cluster(frame(spark, rows).repartition(3), F.col("vec_id"), F.col("embedding"), k=k, rounds=3, dims=4)
        finally:
            clusters.blocks = stored
        assert rows_of(got) == plain(rows, k=k, rounds=3, dims=4)


def test_few_and_no_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [5.0, 2.0]), (2, [5.0, 2.0])]
    assert rows_of(clusters.cluster(frame(spark, few), F.col("vec_id"), F.col("embedding"), dims=2)[0]) == plain(few, dims=2)
    none = clusters.cluster(frame(spark, [(1, None)]), F.col("vec_id"), F.col("embedding"), dims=2)[0]
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    assert clusters.cluster(frame(spark, few).limit(0), F.col("vec_id"), F.col("embedding"))[0].count() == 0


def test_clashing_names_and_floats(spark):
    rows = [(i, [i * 0.1, -i * 0.3, 1 / 3]) for i in range(50)]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int, v string")
    want = plain([(i, [float(np.float32(x)) for x in v]) for i, v in rows], k=5, dims=3)
    assert rows_of(clusters.cluster(table, F.col("vec_id"), F.col("embedding"), k=5, dims=3)[0]) == want


def test_large_components_are_exact_or_an_error(spark):
    big = [(i, [3e5 * (i % 7) + i, -1e4 * i, 0.0]) for i in range(60)]
    assert rows_of(clusters.cluster(frame(spark, big), F.col("vec_id"), F.col("embedding"), k=6, dims=3)[0]) == plain(big, k=6, dims=3)
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster(frame(spark, [(1, [1e30, 0.0, 0.0])]), F.col("vec_id"), F.col("embedding"), k=1, dims=3)


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    vectors = np.floor(np.concatenate([rng.normal(size=(50, 8)) * 4 + c for c in rng.normal(size=(20, 8)) * 400]))
    tree = clusters.CoverTree(vectors)
    assert sorted(tree.order.tolist()) == list(range(len(vectors)))
    for c, r, b, e, kids in zip(tree.centre, tree.radius, tree.begin, tree.end, tree.children, strict=True):
        inside = vectors[tree.order[b:e]]
        far = np.sqrt(((inside - vectors[c]) ** 2).sum(axis=1))
        assert far.max() == pytest.approx(r) and (not kids or (b, e) == (min(tree.begin[k] for k in kids), max(tree.end[k] for k in kids)))
        heads = vectors[[tree.centre[k] for k in kids]]
        apart = np.sqrt(clusters.squared(heads, heads)) if kids else np.zeros((0, 0))
        assert (apart[~np.eye(len(kids), dtype=bool)] > r / 2).all()
    again = clusters.CoverTree.load(tree.dump(), len(tree.centre))
    assert all(np.array_equal(getattr(again, n), getattr(tree, n)) for n in ("centre", "radius", "begin", "end", "order")) and again.children == tree.children
    centroids = vectors[rng.choice(len(vectors), 200, replace=False)]
    ordered = vectors[tree.order]
    at, whole, compared = clusters.assign(ordered, tree, clusters.Centroids(centroids))
    assert at.tolist() == clusters.squared(ordered, centroids).argmin(axis=1).tolist()
    assert compared < len(vectors) * len(centroids) / 3
    counts, totals = clusters.sums(ordered, at, whole, len(centroids))
    assert counts.sum() == len(vectors) and totals.sum(axis=0).tolist() == vectors.sum(axis=0).astype(int).tolist()
