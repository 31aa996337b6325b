"""Near-duplicate detection by b-bit MinHash, confirmed on the full shingle sets.

1.  Every text becomes its set of word shingles, ``perms`` minima, ``bands``
    band keys and a signature of the low ``bits`` bits of each minimum.
2.  Texts with equal sets form one class; only its least id goes on.
3.  Classes that share a band key are candidates.  Their connected components
    are the areas in which links can lie.
4.  Inside an area of at most ``block`` classes all signatures are compared by
    bit counts, corrected for chance collisions; pairs whose estimate is at
    most six deviations below the threshold are confirmed by exact set sizes.
    A union-find skips pairs that are connected already, so a group of many
    copies costs one confirmed link for each text, and only those leave the task.
5.  Larger areas are cut into blocks.  First every block meets a hub of few
    classes, which links a group of copies at once.  Two classes that both
    belong to the area's largest component need no link.  So if at most
    ``block`` classes are outside it, these meet every block.
6.  If more are outside, the area is a chain of pages with much text in common
    but no link, and pairs are looked up by shingles instead: shingles are put
    in order of how many of these classes hold them, and two similar sets must
    share one among the first few of each, at places that leave room for
    enough others.  What pages have in common comes last in that order, so
    such pairs never meet, and the cost follows the number of shingles.
7.  Where no shingle is rare, as with pages composed of a few shared
    paragraphs, that lookup would pair nearly all classes.  How many pairs it
    would make is counted first; areas with more than ``PAIRS`` a class compare
    their blocks instead, strip against strip: signatures by bit counts, and
    sets only of pairs above the floor, many at a time by one product of
    matrices of their common shingles.  No pair leaves a task but a confirmed
    link between texts that the task has not connected yet.

With 32 bands of 5 a pair at similarity 0.85 lacks a common band with
probability 7e-9, at 0.8 with 3e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.components import Forest, components
from quillmark.llm.store import bound_batches, materialize

_U32 = np.uint32


class MinHash:
    """Minima, band keys and b-bit signatures of many sets at once."""

    def __init__(self, bands: int = 32, rows: int = 5, bits: int = 2, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.n = bands * rows
        self.mask = rng.integers(0, 2**32, self.n, dtype=np.uint32)
        self.mult = rng.integers(0, 2**32, self.n, dtype=np.uint32) | _U32(1)
        self.words = -(-self.n * bits // 64)

    def minima(self, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """uint32, sets x perms; every set must have a member."""
        sizes = np.diff(begin)
        out = np.empty((len(sizes), self.n), np.uint32)
        small = (values >> K.U64(32)).astype(np.uint32)
        for i, j in K.slabs(sizes, 32_768):
            part, at = small[begin[i] : begin[j]], begin[i:j] - begin[i]
            for p in range(self.n):
                out[i:j, p] = np.minimum.reduceat((part ^ self.mask[p]) * self.mult[p], at)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """int64, sets x bands; the number of the band is part of its key."""
        m = minima.astype(np.uint64).reshape(len(minima), self.bands, self.rows)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), m.shape[:2]).copy()
        for r in range(self.rows):
            key = K.mix(key * K.U64(0x9E3779B97F4A7C15) + m[:, :, r])
        return key.view(np.int64)

    def signatures(self, minima: np.ndarray) -> np.ndarray:
        """uint64, sets x words: the low bits of each minimum, packed."""
        low = (K.mix(minima.astype(np.uint64)) & K.U64((1 << self.bits) - 1)).astype(np.uint64)
        out = np.zeros((len(minima), self.words), np.uint64)
        each = 64 // self.bits
        for p in range(self.n):
            out[:, p // each] |= low[:, p] << K.U64(self.bits * (p % each))
        return out

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarity of all pairs of two signature arrays, corrected for chance collisions."""
        each = 64 // self.bits
        field = sum(1 << (self.bits * i) for i in range(each))
        differ = np.zeros((len(a), len(b)), np.int64)
        for w in range(self.words):
            x = a[:, None, w] ^ b[None, :, w]
            for s in range(1, self.bits):
                x = x | (x >> K.U64(s))  # the lowest bit of a field gathers all its bits
            differ += np.bitwise_count(x & K.U64(field))
        chance = 0.5**self.bits
        return ((1 - differ / self.n) - chance) / (1 - chance)

    def floor(self, threshold: float) -> float:
        """Six deviations of the estimate below the threshold."""
        chance = 0.5**self.bits
        p = threshold + (1 - threshold) * chance
        return threshold - 6 * math.sqrt(p * (1 - p) / self.n) / (1 - chance)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


Block = tuple[np.ndarray, list[np.ndarray], np.ndarray]  # ids, sets, signatures


#: From so many pairs of two blocks on, their common shingles are counted by matrices, so many columns at a time.
DENSE, COLUMNS = 256, 4096


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """float32, left x right: how many values two sorted sets have in common, exactly."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(part) for part in (left, right)]
    rows = [np.repeat(np.arange(len(part)), [len(x) for x in part]) for part in (left, right)]
    common = np.intersect1d(*flat)
    at = [K.lookup(common, f) for f in flat]
    held = [(r[a >= 0], a[a >= 0]) for r, a in zip(rows, at, strict=True)]
    for lo in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - lo)
        one = []
        for (r, a), part in zip(held, (left, right), strict=True):
            matrix = np.zeros((len(part), wide), np.float32)
            here = (a >= lo) & (a < lo + wide)
            matrix[r[here], a[here] - lo] = 1
            one.append(matrix)
        out += one[0] @ one[1].T
    return out


def links_between(hasher: MinHash, left: Block, right: Block, percent: int, forest: Forest | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between two blocks (or inside one), without those that ``forest`` connects; it learns them."""
    forest, out = forest or Forest(), []
    same = left is right
    estimate = hasher.estimate(left[2], right[2])
    n, m = (np.array([len(s) for s in part[1]])[:, None] for part in (left, right))
    near = 100 * np.minimum(n, m.T) >= percent * np.maximum(n, m.T)  # sets of such sizes can be alike
    i, j = np.nonzero(near & (estimate >= hasher.floor(percent / 100)))
    keep = i < j if same else left[0][i] != right[0][j]
    i, j = i[keep], j[keep]
    if len(i) >= DENSE:
        p, q = np.unique(i), np.unique(j)
        x, y = np.searchsorted(p, i), np.searchsorted(q, j)
        both = shared([left[1][k] for k in p], [right[1][k] for k in q])[x, y].astype(np.int64)
        sure = 100 * both >= percent * (n[i, 0] + m[j, 0] - both)
        for a, b in zip(left[0][i[sure]].tolist(), right[0][j[sure]].tolist(), strict=True):
            if forest.link(a, b):
                out.append((min(a, b), max(a, b)))
        return out
    order = np.argsort(-estimate[i, j], kind="stable")
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = int(left[0][x]), int(right[0][y])
        if forest.find(a) != forest.find(b) and alike(left[1][x], right[1][y], percent):
            forest.link(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def _sets(column: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text, and their numbers."""
    words, first = K.hashed(column, K.BLANK)
    values, begin = K.shingles(words, first, k)
    sets = [K.unique_sorted(values[begin[i] : begin[i + 1]]) for i in range(len(column))]
    return sets, np.fromiter(map(len, sets), np.int64, len(sets))


def _sketch(hasher: MinHash, sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the non-empty sets, their band keys and signatures."""
    some = np.flatnonzero(sizes)
    if not len(some):
        return some, np.zeros((0, hasher.bands), np.int64), np.zeros((0, hasher.words), np.uint64)
    minima = hasher.minima(np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])]))
    return some, hasher.keys(minima), hasher.signatures(minima)


def _lists(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, words: int = 5, percent: int = 80, block: int = 256, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are what blanks separate, A-Z read as a-z.  A text with fewer words
    than a shingle has its whole sequence as one; null, empty and blank texts
    have no shingle and stay alone.  component_id is the least doc_id that
    links reach; kept marks that document.  Rows with a null doc_id take no
    part: their component_id is null and they are kept.  Rows with the same
    doc_id count as one document, of which the links of all rows hold.
    """
    spark = docs.sparkSession
    bound_batches(spark, 8)
    hasher = MinHash()
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes = _sets(batch.column(1), words)
            some, keys, _ = _sketch(hasher, sets, sizes)
            with np.errstate(over="ignore"):
                one = np.array([s.sum() ^ K.U64(len(s)) for s in sets], np.uint64).view(np.int64)
                two = np.array([K.mix(s).sum() for s in sets], np.uint64).view(np.int64)
            bands: list = [None] * len(sets)
            for i, k in zip(some.tolist(), keys, strict=True):
                bands[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(one), pa.array(two), _lists(bands)], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    sketches = materialize(rows.mapInArrow(K.tidy(sketch), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands binary"), "sketches")
    classes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes, "classes")
    found = _class_components(rows, classes, hasher, words, percent, block, broadcast_ids)
    named = materialize(classes.drop("bands").join(found, "class_id", "left").select("k1", "k2", F.coalesce("component_id", "class_id").alias("component_id")), "named")
    # an empty text has no class: a key of its own keeps such rows apart
    empty = F.col("n_shingles") == 0
    keyed = sketches.select("doc_id", "n_shingles", F.when(empty, F.xxhash64("doc_id")).otherwise(F.col("k1")).alias("k1"), F.when(empty, F.lit(None).cast("long")).otherwise(F.col("k2")).alias("k2"))
    out = keyed.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _class_components(rows: DataFrame, classes: DataFrame, hasher: MinHash, words: int, percent: int, block: int, broadcast_ids: int) -> DataFrame:
    """(class_id, component_id) of all classes that could have a link."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), hasher.bands)), pa.array(keys)], ["class_id", "band"]) if n else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["class_id", "band"])

    bands = materialize(classes.select("class_id", "bands").mapInArrow(K.tidy(explode), "class_id bigint, band bigint"), "bands")
    heads = materialize(bands.groupBy("band").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a != z").select("band", "a"), "heads")
    areas = components(bands.join(heads, "band").where("a != class_id").select("a", F.col("class_id").alias("b")).distinct())
    areas = areas.select(F.col("node").alias("class_id"), F.col("component").alias("area"))
    sizes = materialize(areas.groupBy("area").agg(F.ceil(F.count("*") / block).alias("blocks")), "sizes")

    # whole sets, of candidates only; at most broadcast_ids ids are broadcast, more are joined by a shuffle
    placed = areas.join(sizes, "area").select(F.col("class_id").alias("doc_id"), "area", "blocks", F.pmod(F.xxhash64("class_id"), F.col("blocks")).alias("block"))
    placed = materialize(placed, "placed")
    n = placed.count()
    cand = rows.join(F.broadcast(placed) if n <= broadcast_ids else placed, "doc_id")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, size = _sets(batch.column(1), words)
            some, _, signatures = _sketch(hasher, sets, size)
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 2, 3, 4)] + [_lists([sets[i].tobytes() for i in some]), _lists([s.tobytes() for s in signatures])], ["id", "area", "blocks", "block", "members", "signature"])

    schema = "id bigint, area bigint, blocks bigint, block bigint, members binary, signature binary"
    sets = cand.select("doc_id", "text", "area", "blocks", "block").mapInArrow(K.tidy(members), schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, Block]]:
        """(area, blocks, block, members) from rows sorted by area and block."""
        key, ids, each, sigs = None, [], [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for id_, area, blocks, number, members_, sig in zip(*cols, strict=True):
                if (area, blocks, number) != key:
                    if key:
                        yield *key, (np.array(ids, np.int64), each, np.array(sigs))
                    key, ids, each, sigs = (area, blocks, number), [], [], []
                ids.append(id_)
                each.append(np.frombuffer(members_, np.uint64))
                sigs.append(np.frombuffer(sig, np.uint64))
        if key:
            yield *key, (np.array(ids, np.int64), each, np.array(sigs))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Areas of one block give links at once; blocks of the others go on as one row each."""
        for area, blocks, number, part in packed(batches):
            found = links_between(hasher, part, part, percent) if blocks == 1 or number == 0 else []
            a, b = ([x[0] for x in found], [x[1] for x in found])
            rest = None if blocks == 1 else _dump(part)
            yield pa.RecordBatch.from_arrays([pa.array([area]), pa.array([number]), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64())), pa.array([rest], pa.binary())], ["area", "block", "a", "b", "data"])

    # a block is about ``block`` rows: every key is small
    solved = sets.repartition("area", "block").sortWithinPartitions("area", "block").mapInArrow(K.tidy(solve), "area bigint, block bigint, a array<bigint>, b array<bigint>, data binary")
    solved = materialize(solved, "solved")
    links = solved.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")
    big = solved.where(F.col("data").isNotNull()).select("area", "block", "data")
    if not big.isEmpty():
        links = links.unionByName(_between_blocks(big, links, areas, hasher, percent, block))
    found = components(links)
    return found.select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))


def _dump(part: Block) -> bytes:
    ids, sets, sigs = part
    head = np.array([len(ids), sigs.shape[1] if len(ids) else 0], np.int64)
    return b"".join([head.tobytes(), ids.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), np.ascontiguousarray(sigs).tobytes(), *(s.tobytes() for s in sets)])


def _load(data: bytes) -> Block:
    n, words = np.frombuffer(data, np.int64, 2)
    ids = np.frombuffer(data, np.int64, n, 16)
    sizes = np.frombuffer(data, np.int64, n, 16 + 8 * n)
    sigs = np.frombuffer(data, np.uint64, n * words, 16 + 16 * n).reshape(n, words)
    flat = np.frombuffer(data, np.uint64, int(sizes.sum()), 16 + 16 * n + 8 * n * words)
    return ids, np.split(flat, np.cumsum(sizes)[:-1]), sigs


def _pick(part: Block, ids: set[int]) -> Block:
    at = [i for i, x in enumerate(part[0].tolist()) if x in ids]
    return part[0][at], [part[1][i] for i in at], part[2][at]


HUB, CHUNK, STARS = 32, 64, 8  # classes of a hub; blocks that meet one copy of it; hubs of a shingle
PAIRS = 64  # most pairs a class that a lookup by shingles may make; beyond, blocks are compared
STRIPS, STRIP = 8, (4, 32)  # strips that an area is cut into, and the least and most blocks of one
_PAIR = "a bigint, b bigint"
_MEMBER = "area bigint, id bigint, n bigint, members binary"


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])


def _against_all(heads: DataFrame, big: DataFrame, hasher: MinHash, percent: int) -> DataFrame:
    """Links between ``heads(area, data)``, one block for an area, and all blocks of the area.

    A copy of the head goes to every CHUNK blocks, so no area is one key.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _links_batch(links_between(hasher, _load(x), _load(y), percent))

    last = big.groupBy("area").agg(F.floor(F.max("block") / CHUNK).alias("last"))
    left = heads.join(last, "area").select("area", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"), F.col("data").alias("x"))
    both = big.select("area", F.floor(F.col("block") / CHUNK).alias("chunk"), F.col("data").alias("y")).join(left, ["area", "chunk"])
    return materialize(both.select("x", "y").mapInArrow(K.tidy(meet), _PAIR), "spread")


def _between_blocks(big: DataFrame, links: DataFrame, areas: DataFrame, hasher: MinHash, percent: int, block: int) -> DataFrame:
    """Links between the blocks of large areas, as steps 5 and 6 above say."""

    def hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_load(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_dump((p[0][:HUB], p[1][:HUB], p[2][:HUB])) for p in parts], pa.binary())], ["area", "data"])

    spread = _against_all(big.where("block = 0").select("area", "data").mapInArrow(K.tidy(hub), "area bigint, data binary"), big, hasher, percent)
    large = big.select("area").distinct()
    inside = areas.join(F.broadcast(large), "area", "left_semi") if large.count() <= 100_000 else areas.join(large, "area", "left_semi")
    found = components(links.unionByName(spread)).select(F.col("node").alias("class_id"), "component")
    state = inside.join(found, "class_id", "left").select("area", "class_id", F.coalesce("component", "class_id").alias("component"))
    state = materialize(state, "state")
    most = state.groupBy("area", "component").count().groupBy("area").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.sum("count").alias("size"), F.max("count").alias("largest"))
    most = materialize(most.withColumn("outside", F.col("size") - F.col("largest")).where("outside > 0"), "most")
    rest = materialize(state.join(most, "area").where("component != most").select("area", "class_id", "outside"), "rest")
    few, many = rest.where(F.col("outside") <= block), most.where(F.col("outside") > block).select("area")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for area, data, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = _pick(_load(data), set(ids))
                n = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array([area] * n, pa.int64()), pa.array([_dump((part[0][i : i + 1], part[1][i : i + 1], part[2][i : i + 1])) for i in range(n)], pa.binary())], ["id", "area", "data"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for each in batch.column(1).to_pylist():
                parts = [_load(x) for x in each]
                out.append(_dump((np.concatenate([p[0] for p in parts]), [s for p in parts for s in p[1]], np.concatenate([p[2] for p in parts]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["area", "data"])

    out = spread
    if not few.isEmpty():
        sizes = big.groupBy("area").agg(F.count("*").alias("blocks"))
        # no more than ``block`` ids of an area, so both lists are bounded
        ids = few.join(sizes, "area").groupBy("area", F.pmod(F.xxhash64("class_id"), F.col("blocks")).alias("block")).agg(F.collect_list("class_id").alias("ids"))
        chosen = big.join(ids, ["area", "block"]).select("area", "data", "ids").mapInArrow(K.tidy(pick), "id bigint, area bigint, data binary")
        heads = chosen.groupBy("area").agg(F.collect_list("data").alias("parts")).mapInArrow(K.tidy(join_up), "area bigint, data binary")
        out = out.unionByName(_against_all(heads, big, hasher, percent))
    if not many.isEmpty():
        open_ = big.join(many, "area", "left_semi")
        crowded, found = _by_shingles(open_, rest, links.unionByName(out), percent)
        out = out.unionByName(found)
        if not crowded.isEmpty():
            out = out.unionByName(_by_strips(open_.join(crowded, "area", "left_semi"), hasher, percent))
    return out


def _by_strips(blocks: DataFrame, hasher: MinHash, percent: int) -> DataFrame:
    """Links between all classes of each area, by comparing strips of its blocks (step 7).

    A pair of strips is a job of bounded size; a block goes to as many jobs as
    its area has strips, which grows only beyond STRIPS of the widest.
    """
    sizes = materialize(blocks.groupBy("area").agg((F.max("block") + 1).alias("n")), "areas")
    wide = F.least(F.greatest(F.ceil(F.col("n") / STRIPS), F.lit(STRIP[0])), F.lit(STRIP[1]))
    placed = blocks.join(sizes.select("area", wide.alias("wide"), F.ceil(F.col("n") / wide).alias("strips")), "area").withColumn("strip", F.floor(F.col("block") / F.col("wide")))
    others = F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)
    sent = placed.select("area", "strip", "block", "data", F.explode(others).alias("other")).select("area", F.least("strip", "other").alias("i"), F.greatest("strip", "other").alias("j"), "strip", "block", "data")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, first, held, forest = None, -1, [], Forest()
        for batch in batches:
            for area, i, j, strip, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True):
                if (area, i, j) != job:
                    job, first, held, forest = (area, i, j), strip, [], Forest()
                part = _load(data)
                # blocks of the first strip are kept, and meet each other in the job of that strip with itself alone
                others = held if strip != first or i == j else []
                found = [f for other in others for f in links_between(hasher, other, part, percent, forest)]
                if i == j:
                    found += links_between(hasher, part, part, percent, forest)
                if strip == first:
                    held.append(part)
                if found:
                    yield _links_batch(found)

    jobs = sent.repartition("area", "i", "j").sortWithinPartitions("area", "i", "j", "strip", "block")
    return materialize(jobs.select("area", "i", "j", "strip", "block", "data").mapInArrow(K.tidy(meet), _PAIR), "strips")


def _by_shingles(blocks: DataFrame, rest: DataFrame, links: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Areas in ``blocks`` where this would make too many pairs; and of the others links between classes that ``links`` do not connect, by rare shingles (step 6)."""
    p = percent

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for area, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sets, _ = _load(data)
                yield pa.RecordBatch.from_arrays([pa.array([area] * len(ids), pa.int64()), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["area", "id", "n", "members"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g = np.frombuffer(batch.column(3)[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), batch.column(i)[row].as_py())) for i in range(3)] + [pa.array(g)], ["area", "id", "n", "g"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            yield _links_batch([(a, b) for a, b, x, y in rows if alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)])

    sets = materialize(blocks.select("area", "data").mapInArrow(K.tidy(members), _MEMBER), "members")
    tokens = sets.mapInArrow(K.tidy(explode), "area bigint, id bigint, n bigint, g bigint")
    held = tokens.join(rest.select(F.col("class_id").alias("id")), "id", "left_semi").groupBy("area", "g").agg(F.count("*").alias("df"))
    # rarest first; shingles of no class outside the largest component come before all, and never meet
    order = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "g")
    placed = tokens.join(held, ["area", "g"], "left").withColumn("i", F.row_number().over(order))
    # overlap of sets of n and m members must reach p (n + m) / (100 + p): so many first shingles must be looked at for any partner, and for one that is no shorter
    probe, index = F.expr(f"n - ({p} * n + 99) div 100 + 1"), F.expr(f"n - (2 * {p} * n + {99 + p}) div {100 + p} + 1")
    # if a shingle is the first that two sets share, what follows it limits the size of the partner
    cap = F.expr(f"((n - i + 1) * {100 + p}) div {p} - n")
    first = placed.where((F.col("i") <= probe) & F.col("df").isNotNull()).select("area", "g", "id", "n", cap.alias("cap"), (F.col("i") <= index).alias("idx")).where(100 * F.col("cap") >= p * F.col("n"))
    first = materialize(first, "first")
    pairs_of = first.groupBy("area", "g").agg(F.count("*").alias("n"), F.sum(F.col("idx").cast("long")).alias("m")).groupBy("area").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))
    crowded = materialize(sets.groupBy("area").agg(F.count("*").alias("size")).join(pairs_of, "area").where(F.col("pairs") > PAIRS * F.col("size")).select("area"), "crowded")
    if not crowded.isEmpty():
        first = materialize(first.join(crowded, "area", "left_anti"), "first")
    found = None
    for stars in (True, False):  # first each class against a few of those that hold its shingle, then all that are still apart
        known = components(links if found is None else links.unionByName(found)).select(F.col("node").alias("id"), F.col("component").alias("c"))
        now = first.join(known, "id", "left").withColumn("c", F.coalesce("c", "id"))
        bounds = [F.min(F.when(F.col("idx"), F.col("n"))).alias("least"), F.max(F.when(F.col("idx"), F.col("cap"))).alias("room"), F.min("c").alias("lo"), F.max("c").alias("hi")]
        hubs = [F.min_by(F.struct("id", "n", "cap", "c"), F.when(F.col("idx"), F.xxhash64("id", F.lit(k)))).alias(f"h{k}") for k in range(STARS if stars else 0)]
        groups = materialize(now.groupBy("area", "g").agg(*bounds, *hubs).where("lo != hi AND least IS NOT NULL"), "groups")
        if groups.isEmpty():
            break
        near = now.join(groups, ["area", "g"]).where((F.col("cap") >= F.col("least")) & (F.col("n") <= F.col("room")))
        if stars:
            short = near.select("id", "n", "cap", "c", F.explode(F.array(*[f"h{k}" for k in range(STARS)])).alias("x")).select("id", "n", "cap", "c", *[F.col(f"x.{n}").alias(f"x_{n}") for n in ("id", "n", "cap", "c")])
        else:
            near = materialize(near.select("area", "g", "id", "n", "cap", "c", "idx"), "near")
            short = near.join(near.where("idx").select("area", "g", *[F.col(n).alias(f"x_{n}") for n in ("id", "n", "cap", "c")]), ["area", "g"])
        pairs = short.where("x_c != c AND x_n <= n AND n <= x_cap AND x_n <= cap").select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()
        both = materialize(pairs, "candidates").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        new = materialize(both.select("a", "b", "x", "y").mapInArrow(K.tidy(confirm), _PAIR), "confirmed")
        found = new if found is None else found.unionByName(new)
    return crowded, links.limit(0) if found is None else found
