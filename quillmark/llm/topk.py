"""Exact top-k inner products with norm buckets.

Vectors are scaled to integers and ranged by length into buckets of about
``bucket_rows``, longest first.  Queries form blocks.  A first pass over the
bucket of the longest vectors gives every query a lower bound of its k-th
score.  Then each block meets the buckets in order of length; from a query's
bound, its length and a bucket's greatest length follows the local cosine
threshold that a vector in this bucket must reach:

* above 1: the bucket is passed over for this query;
* high: coordinate pruning; the vector's share in each of the query's largest
  coordinates must lie in the interval that the threshold leaves;
* else: length pruning; vectors shorter than the bound allows are cut off.

What is left is verified by full integer products, and the bound rises as
results come in.

Blocks of queries and buckets lie in strips.  A job is a strip of queries
against a strip of buckets; which jobs there are follows from the strips' norms
and bounds alone, two short lists of numbers, so a bucket is sent once for each
strip of queries that may need it, and nothing is joined on a constant key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.store import bound_batches, materialize

_HIGH = 0.8  # local cosine thresholds from which on coordinates are pruned
_FOCUS = 3


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _blob(ids: np.ndarray, rows: np.ndarray) -> bytes:
    """Ids and vectors, in the narrowest integers that hold them."""
    top = int(np.abs(rows).max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return np.array([len(ids), np.dtype(kind).itemsize], np.int64).tobytes() + ids.tobytes() + np.ascontiguousarray(rows.astype(kind)).tobytes()


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[size]
    return np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, kind, -1, 16 + 8 * n).reshape(n, -1).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, norm) in order to blocks of one dimension each: (dim, block, norm, data)."""
    number = TaskContext.get().partitionId() << 24
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def out(dim: int, least: int) -> Iterator[pa.RecordBatch]:
        nonlocal number
        ids, rows, norms = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        while len(ids) >= least:
            part = np.lexsort((ids[:most], -norms[:most]))
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([number]), pa.array([float(norms[:most].max()) ** 0.5]), pa.array([_blob(ids[part], rows[part])], pa.binary())], ["dim", "block", "norm", "data"])
            number += 1
            ids, rows, norms = ids[most:], rows[most:], norms[most:]
        if len(ids):
            held[dim] = [(ids, rows, norms)]

    for batch in batches:
        ids, norms = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            held.setdefault(dim, []).append((ids[at], flat[begin[at][:, None] + np.arange(dim)], norms[at]))
            if sum(len(x[0]) for x in held[dim]) >= most:
                yield from out(dim, most)
    for dim in list(held):
        yield from out(dim, 1)


_BLOCK = "dim bigint, block bigint, norm double, data binary"


class Best:
    """The k best of every query of a block so far; ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.bound = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.bound[q] = max(self.bound[q], float(s[order[-1]]))


class Bucket:
    """Vectors sorted by length descending, ready for products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.floats = vectors.astype(np.float64)
        self.lengths = np.sqrt((self.floats**2).sum(axis=1))
        self.top = float(np.abs(vectors).max(initial=0))


def search(best: Best, q_ids: np.ndarray, queries: np.ndarray, bucket: Bucket) -> None:
    """Meet one bucket; ``best`` is updated."""
    c_ids, lengths = bucket.ids, bucket.lengths
    exact = np.abs(queries).max(initial=0).astype(float) * bucket.top * max(1, queries.shape[1]) < 2.0**53
    kind = np.float64 if exact else np.int64
    v = bucket.floats if exact else bucket.vectors
    q_len = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(best.bound > 0, best.bound / q_len, -np.inf) * (1 - 1e-9)  # shortest length that can reach the bound
    # vectors are sorted by length, so what a query needs is a prefix
    prefix = np.searchsorted(-lengths, -need, side="right")
    local = np.where(best.bound > 0, best.bound / np.maximum(q_len * lengths[0], 1e-300), -1.0) if len(lengths) else np.zeros(len(q_ids))
    by_length = np.flatnonzero((prefix > 0) & (local < _HIGH))
    for lo in range(0, len(by_length), 128):
        part = by_length[lo : lo + 128]
        n = int(prefix[part].max())
        products = queries[part].astype(kind) @ v[:n].T
        for row, q in enumerate(part.tolist()):
            _take(best, q, q_ids[q], products[row, : prefix[q]], c_ids[: prefix[q]])
    by_coordinate = np.flatnonzero((prefix > 0) & (local >= _HIGH))
    if len(by_coordinate):
        unit = bucket.floats / np.maximum(lengths, 1e-300)[:, None]
        for q in by_coordinate.tolist():
            n = int(prefix[q])
            u = queries[q] / q_len[q]
            t = min(1.0, local[q]) - 1e-9
            keep = np.ones(n, bool)
            for f in np.argsort(-np.abs(u))[:_FOCUS]:
                half = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
                keep &= (unit[:n, f] >= u[f] * t - half if u[f] >= 0 else unit[:n, f] <= u[f] * t + half)
            at = np.flatnonzero(keep)
            _take(best, q, q_ids[q], v[at] @ queries[q].astype(kind), c_ids[at])


def _take(best: Best, q: int, own: int, scores: np.ndarray, ids: np.ndarray) -> None:
    ok = (scores >= best.bound[q]) & (ids != own)
    if ok.any():
        s, i = scores[ok], ids[ok]
        if len(s) > 4 * best.k:  # all that tie with the k-th stay for the order by id
            least = np.partition(s, len(s) - best.k)[len(s) - best.k]
            s, i = s[s >= least], i[s >= least]
        best.add(q, s.astype(np.int64), i)


def top_k(rows: DataFrame, vec_id: Column, vector: Column, is_query: Column, k: int = 20, scale: int = 64, bucket_rows: int = 4096, query_rows: int = 512, strip: int = 16, most_strips: int = 50_000, most_tasks: int = 10_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; only vectors of equal dimension meet.  A row
    with the query's own id is left out; rows with a repeated id all count, and
    a query row that occurs twice is answered twice.  Ties go to the smaller id.
    Scores must fit 64 bits.  Strips grow so that no more than ``most_strips``
    of them are known to the driver, and pairs of strips are dealt to no more
    than ``most_tasks`` tasks, each of which takes one pair after the other.
    """
    spark = rows.sparkSession
    bound_batches(spark, 8)
    v = rows.select(vec_id.cast("long").alias("id"), integers(vector, scale).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    v = materialize(v.withColumn("norm", norm), "vectors")
    n, asked = v.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    buckets = max(1, -(-n // bucket_rows))
    packed = v.repartitionByRange(buckets, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id").select("id", "v", "norm").mapInArrow(lambda b: _pack(b, bucket_rows), _BLOCK)
    c_strip = max(strip, -(-buckets // most_strips))
    # block numbers follow the range partitions, so strips are in order of length
    packed = materialize(packed.withColumn("strip", F.floor(F.shiftright("block", 24) / c_strip)), "buckets")
    per = max(1, -(-asked // query_rows))
    q_strip = max(strip, -(-per // most_strips))
    asks = v.where("q").select("id", "v", "norm").repartition(per, F.xxhash64("id")).mapInArrow(lambda b: _pack(b, query_rows), _BLOCK)
    asks = materialize(asks.withColumn("strip", F.floor(F.shiftright("block", 24) / q_strip)), "queries")

    # every query's first bound, from the bucket of the longest vectors of its dimension: one row for each dimension
    head = packed.groupBy("dim").agg(F.min_by("block", F.struct(-F.col("norm"), "block")).alias("block"))
    head = packed.join(F.broadcast(head), ["dim", "block"]).select("dim", F.col("data").alias("c"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, part, q, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, queries = _unblob(q)
                best = Best(len(ids), k)
                if c is not None:
                    search(best, ids, queries, Bucket(*_unblob(c)))
                length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
                need = np.where(best.bound > 0, best.bound / np.maximum(length, 1e-300), 0.0).min() * (1 - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([block]), pa.array([part]), pa.array([np.array([len(ids)], np.int64).tobytes() + best.bound.tobytes() + q], pa.binary()), pa.array([float(need)])], ["dim", "block", "strip", "data", "need"])

    few = head.count() <= 64
    blocks = asks.select("dim", "block", "strip", F.col("data").alias("q")).join(F.broadcast(head) if few else head, "dim", "left").select("dim", "block", "strip", "q", "c")
    blocks = materialize(blocks.mapInArrow(first, "dim bigint, block bigint, strip bigint, data binary, need double"), "bounds")
    longest: dict[int, dict[int, float]] = {}
    for r in packed.groupBy("dim", "strip").agg(F.max("norm").alias("norm")).collect():  # at most most_strips numbers a dimension
        longest.setdefault(r.dim, {})[r.strip] = r.norm
    needed: dict[int, dict[int, float]] = {}
    for r in blocks.groupBy("dim", "strip").agg(F.min("need").alias("need")).collect():
        needed.setdefault(r.dim, {})[r.strip] = r.need
    bound = spark.sparkContext.broadcast((longest, needed))

    def jobs(side: int):
        """Rows (dim, block, strip, data) once for every strip of the other side that may matter: (dim, q_strip, c_strip, side, block, data)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            longest, needed = bound.value
            for batch in batches:
                for dim, block, part, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if side:
                        others = [q for q, need in needed.get(dim, {}).items() if longest[dim][part] >= need]
                    else:
                        others = [c for c, norm in longest.get(dim, {}).items() if norm >= needed[dim][part]]
                    own = [part] * len(others)
                    for lo in range(0, len(others), 16):
                        some, mine = others[lo : lo + 16], own[lo : lo + 16]
                        q, c = (some, mine) if side else (mine, some)
                        yield pa.RecordBatch.from_arrays([pa.array([dim] * len(some)), pa.array(q), pa.array(c), pa.array([side] * len(some), pa.int32()), pa.array([block] * len(some)), pa.array([data] * len(some), pa.binary())], ["dim", "q_strip", "c_strip", "side", "block", "data"])

        return run

    wire = "dim bigint, q_strip bigint, c_strip bigint, side int, block bigint, data binary"
    both = blocks.select("dim", "block", "strip", "data").mapInArrow(jobs(0), wire).unionAll(packed.select("dim", "block", "strip", "data").mapInArrow(jobs(1), wire))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for block, ids, _, best in held:
                size = [len(s) for s in best.scores]
                place = np.repeat(np.arange(len(ids)), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block)), pa.array(place), pa.array(ids[place]), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for dim, q, c, side, block, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (dim, q, c) != now:
                    yield from out()
                    now, held = (dim, q, c), []
                if side == 0:
                    size = int.from_bytes(data[:8], "little")
                    ids, queries = _unblob(data[8 + 8 * size :])  # behind the bounds
                    best = Best(len(ids), k)
                    best.bound = np.frombuffer(data, np.float64, size, 8).copy()
                    held.append((block, ids, queries, best))
                elif held:
                    bucket = Bucket(*_unblob(data))
                    for _, ids, queries, best in held:
                        search(best, ids, queries, bucket)
        yield from out()

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most_tasks, -(-per // q_strip) * min(64, -(-buckets // c_strip))))
    found = both.repartition(spread, "dim", "q_strip", "c_strip").sortWithinPartitions("dim", "q_strip", "c_strip", "side", "block")
    found = found.mapInArrow(meet, "block bigint, place bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
