"""Lloyd's clustering with two trees.

Vectors are stored once in blocks of bounded size, each with a cover tree: a
node holds all vectors within its radius of its centre, which is one of them,
and its children have centres further apart than half that radius.  In every
round the centroids get such a tree too.  Pairs of a vector node and centroid
nodes go down both trees together: a centroid node goes if even its nearest
point is further than the furthest that another one can be.  A vector node with
one centroid left is added to it as a whole, by running sums; leaves compare
what is left exactly.

Components are whole numbers.  Bounds are floating point with room to spare, and
only what is strictly further goes, so ties reach the exact comparison.  Every
round sends one sum for each centroid and component of each task; what comes to
the driver is ``k`` times the dimension, both parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.store import bound_batches, materialize

LEAF = 16
_SLACK = 1e-9


def kind(largest: int, dims: int) -> type:
    """The type in which squared distances are exact; raises where they leave 64 bits."""
    most = 4 * dims * largest * largest
    if most >= 2**63:
        raise OverflowError(f"components up to {largest}: squared distances leave 64 bits")
    return np.float64 if most < 2**53 else np.int64


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a and b, which have a type from ``kind``."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


class CoverTree:
    """Vectors in the order of their leaves; nodes with centre, radius, range of vectors and children."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        n = len(vectors)
        apart = np.sqrt(np.maximum(squared(vectors, vectors), 0).astype(np.float64))
        self.centre, self.radius, self.begin, self.end = [], [], [], []
        self.children: list[list[int]] = []
        order: list[np.ndarray] = []
        filled = 0
        # a node is made when it is taken from the stack, so vectors are laid down depth first
        stack: list[tuple[int, np.ndarray, int]] = [(0, np.arange(n), -1)] if n else []
        while stack:
            centre, members, parent = stack.pop()
            far = apart[centre, members]
            radius = float(far.max())
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(radius)
            self.begin.append(filled)
            self.end.append(filled + len(members))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if len(members) <= leaf or radius == 0.0:
                order.append(members)
                filled += len(members)
                continue
            heads, left = [centre], members[far > radius / 2]
            while len(left):  # every head is further than half the radius from those before it
                heads.append(int(left[0]))
                left = left[apart[left[0], left] > radius / 2]
            nearest = apart[np.ix_(members, heads)].argmin(axis=1)
            for h, head in enumerate(heads):
                stack.append((head, members[nearest == h], node))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)

    def dump(self) -> bytes:
        width = [len(c) for c in self.children]
        whole = np.array([len(self.centre), len(self.order), *self.centre, *self.begin, *self.end, *width, *(c for each in self.children for c in each), *self.order.tolist()], np.int64)
        return np.array(self.radius, np.float64).tobytes() + whole.tobytes()

    @classmethod
    def load(cls, data: bytes, nodes: int) -> CoverTree:
        tree = cls.__new__(cls)
        tree.radius = np.frombuffer(data, np.float64, nodes).tolist()
        rest = np.frombuffer(data, np.int64, -1, 8 * nodes)
        n, size = int(rest[0]), int(rest[1])
        tree.centre, tree.begin, tree.end, width = (rest[2 + i * n : 2 + (i + 1) * n].tolist() for i in range(4))
        cut = np.cumsum([0, *width])
        kids = rest[2 + 4 * n : 2 + 4 * n + int(cut[-1])]
        tree.children = [kids[cut[i] : cut[i + 1]].tolist() for i in range(n)]
        tree.order = rest[len(rest) - size :]
        return tree


class Centroids:
    """Centroids with their tree.  Nodes from 0 on are the tree's, nodes from ``singles`` on stand for one centroid each."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.points = centroids
        tree = CoverTree(centroids, leaf=1)
        self.singles = len(tree.centre)
        self.number = np.array([*tree.centre, *range(len(centroids))], np.int64)
        self.radius = np.array([*tree.radius, *[0.0] * len(centroids)])
        self.below = [np.array(c or [self.singles + int(m) for m in tree.order[b:e]], np.int64) for c, b, e in zip(tree.children, tree.begin, tree.end, strict=True)]


def assign(vectors: np.ndarray, tree: CoverTree, centroids: Centroids) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
    """The nearest centroid of every vector, those ``vectors`` being in the tree's order; ties to the smaller number.

    Also the ranges (begin, end, centroid) that were assigned as a whole, and how many pairs of vectors and centroids were compared.
    """
    out = np.full(len(vectors), -1, np.int64)
    whole, compared = [], 0
    place = np.empty(len(vectors), np.int64)
    place[tree.order] = np.arange(len(vectors))
    points = centroids.points
    stack = [(0, np.zeros(1, np.int64))] if len(vectors) else []
    while stack:
        node, left = stack.pop()
        radius, centre = tree.radius[node], vectors[place[tree.centre[node]]][None, :]
        leaf = not tree.children[node]
        while True:
            far = np.sqrt(np.maximum(squared(centre, points[centroids.number[left]])[0], 0).astype(np.float64))
            compared += len(left)
            upper = far.min() + radius  # a node's centre is a centroid
            near = far - radius - centroids.radius[left] <= upper + _SLACK * (1 + upper + far + radius + centroids.radius[left])
            left = left[near]
            wide = left < centroids.singles
            if not wide.any() or not (leaf or centroids.radius[left[wide]].max() >= radius):
                break
            left = np.concatenate([left[~wide], *[centroids.below[c] for c in left[wide].tolist()]])
        lo, hi = tree.begin[node], tree.end[node]
        if len(left) == 1 and left[0] >= centroids.singles:
            out[lo:hi] = centroids.number[left[0]]
            whole.append((lo, hi, int(centroids.number[left[0]])))
        elif leaf:
            numbers = np.sort(centroids.number[left])
            out[lo:hi] = numbers[squared(vectors[lo:hi], points[numbers]).argmin(axis=1)]
            compared += (hi - lo) * len(numbers)
        else:
            stack.extend((c, left) for c in tree.children[node])
    return out, whole, compared


def sums(vectors: np.ndarray, out: np.ndarray, whole: list[tuple[int, int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """int64: how many vectors each centroid got, and their sums; ranges that went as a whole by running sums."""
    counts, totals = np.zeros(k, np.int64), np.zeros((k, vectors.shape[1]), np.int64)
    values = vectors.astype(np.int64)
    running = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, axis=0)])
    single = np.ones(len(out), bool)
    for lo, hi, c in whole:
        counts[c] += hi - lo
        totals[c] += running[hi] - running[lo]
        single[lo:hi] = False
    np.add.at(counts, out[single], 1)
    np.add.at(totals, out[single], values[single])
    return counts, totals


_BLOCK = "n int, nodes int, ids binary, vectors binary, tree binary"


def blocks(vectors: DataFrame, vec_id: Column, vector: Column, dims: int, scale: int, size: int = 1024) -> DataFrame:
    """Vectors as whole numbers floor(scale * x), in stored blocks of at most ``size``, each with its cover tree.

    Vectors that are null, of another length, or with a null, infinite or
    undefined component take no part, nor do rows without an id.
    """
    bound_batches(vectors.sparkSession, 8)
    v = vector.cast("array<double>")
    rows = vectors.select(vec_id.cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL").where(F.size("v") == dims)
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, held
            all_ids, all_parts = np.concatenate(ids), np.concatenate(parts)
            done = held if last else held // size * size
            for lo in range(0, done, size):
                block = all_parts[lo : min(lo + size, done)]
                exact = block.astype(kind(int(np.abs(block).max(initial=0)), dims))
                tree = CoverTree(exact)
                yield pa.RecordBatch.from_arrays([pa.array([len(block)], pa.int32()), pa.array([len(tree.centre)], pa.int32()), *(pa.array([b], pa.binary()) for b in (all_ids[lo : lo + len(block)][tree.order].tobytes(), block[tree.order].tobytes(), tree.dump()))], ["n", "nodes", "ids", "vectors", "tree"])
            ids, parts, held = [all_ids[done:]], [all_parts[done:]], held - done

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False))
            if np.abs(flat).max(initial=0) >= 2.0**62:
                raise OverflowError("a scaled component leaves 64 bits")
            ids.append(batch.column(0).to_numpy().copy())
            parts.append(flat.astype(np.int64).reshape(-1, dims))
            held += batch.num_rows
            if held >= size:
                yield from out(False)
        if held:
            yield from out(True)

    return materialize(rows.mapInArrow(K.tidy(run), _BLOCK), "blocks")


def _loaded(batch: pa.RecordBatch, dims: int, largest: int) -> Iterator[tuple[np.ndarray, np.ndarray, CoverTree]]:
    for nodes, ids, vectors, tree in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
        whole = np.frombuffer(vectors, np.int64).reshape(-1, dims)
        exact = whole.astype(kind(max(largest, int(np.abs(whole).max(initial=0))), dims))
        yield np.frombuffer(ids, np.int64), exact, CoverTree.load(tree, nodes)


def _tree(centroids: np.ndarray, held: type) -> Centroids:
    return Centroids(centroids.astype(held))


def first_centroids(vectors: DataFrame, vec_id: Column, vector: Column, dims: int, scale: int, k: int, salt: str) -> np.ndarray:
    """int64, at most k rows: the kept vectors with the least SHA-256 of salt:id, ties by their components."""
    v = vector.cast("array<double>")
    rows = vectors.select(vec_id.cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL").where(F.size("v") == dims)
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), F.transform("v", lambda x: F.floor(scale * x)).alias("v"))
    top = hashed.orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in top], np.int64).reshape(len(top), dims)


def update(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then each centroid that has any to the floored mean of its vectors."""
    k, dims = centroids.shape
    largest = int(np.abs(centroids).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals, trees = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), {}
        for batch in batches:
            for _, vectors, tree in _loaded(batch, dims, largest):
                if vectors.dtype not in trees:
                    trees[vectors.dtype] = _tree(centroids, vectors.dtype.type)
                n, s = sums(vectors, *assign(vectors, tree, trees[vectors.dtype])[:2], k)
                counts += n
                totals += s
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims)), pa.array(np.tile(np.arange(dims), len(some))), pa.array(totals[some].ravel()), pa.array(np.repeat(counts[some], dims))], ["cluster", "dim", "s", "n"])

    parts = stored.mapInArrow(K.tidy(run), "cluster bigint, dim bigint, s bigint, n bigint")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # k x dims rows at most
        out[r.cluster, r.dim] = r.s // r.n
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, vec_id: Column, vector: Column, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, and the centroids.

    ``rounds`` rounds from the centroids of ``first_centroids``, then every
    vector goes to the nearest, ties to the smaller number; distance is squared,
    inertia its sum over the cluster and over all.  Fewer than ``k`` vectors
    give as many centroids; a table without any kept vector gives no row.
    Repeated rows count each time.  Squared distances that leave 64 bits raise
    an error.
    """
    stored = blocks(vectors, vec_id, vector, dims, scale)
    centroids = first_centroids(vectors, vec_id, vector, dims, scale, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = update(stored, centroids)
    largest = int(np.abs(centroids).max(initial=0))
    final = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {}
        for batch in batches:
            for ids, vectors, tree in _loaded(batch, dims, largest):
                if vectors.dtype not in trees:
                    trees[vectors.dtype] = _tree(final, vectors.dtype.type)
                at = assign(vectors, tree, trees[vectors.dtype])[0]
                gap = vectors - final.astype(vectors.dtype)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at.astype(np.int32)), pa.array((gap * gap).sum(axis=1).astype(np.int64))], ["vec_id", "cluster", "distance"])

    found = materialize(stored.mapInArrow(K.tidy(run), "vec_id bigint, cluster int, distance bigint"), "assigned")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    total = sum(r.cluster_inertia for r in each)
    rows = [(int(r.cluster), r.cluster_inertia, total, digest(centroids[r.cluster])) for r in each]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
