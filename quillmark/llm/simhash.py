"""Near-duplicate detection by SimHash, compared exactly in tiles.

1.  Every text becomes a fingerprint of 64 bits: a bit is 1 if it is set in
    over half of the hashes of the text's shingles.
2.  Equal fingerprints are one class, so copies cost nothing further on.
3.  A fingerprint's cell is the list of the population counts of its ``parts``
    equal parts.  Counts of two fingerprints differ by no more, in sum over
    the parts, than their bits do, so cells further apart than the radius need
    no comparison.  Cells are cut into tiles of about ``tile`` fingerprints.
4.  Tiles of the same cell or of cells within the radius meet: exclusive-or and
    bit counts of all pairs in numpy.  A tile pair gives at most one link for
    each fingerprint, a spanning forest of what it found.
5.  Links are solved to connected components.

Work is the number of pairs in cells that can be near: 60 % of all with one
part, 19 % with two, 5 % with four, 0.2 % with eight, and 6 in a million with
sixteen.  ``parts`` follows the number of classes, so that a cell in the middle
keeps a few tiles and the work of a class stays within bounds as the table
grows; the links are the same for any number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.components import components
from quillmark.llm.store import bound_batches, materialize

SEED = 42
BITS = 64
#: Words whose shingles are hashed at a time.
RUN = 1 << 16
#: Cells that as many random fingerprints fill as evenly as if all were equally full, by number of parts.
SPREAD = {1: 14, 2: 100, 4: 2_600, 8: 460_000, 16: 1_000_000_000}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each begins and ends there."""
    sizes = ends - starts + 1
    end = np.cumsum(sizes)
    begin = end - sizes
    source = np.repeat(starts - begin, sizes) + np.arange(end[-1])
    out = _LOWER[data[np.minimum(source, len(data) - 1)]]
    out[end - 1] = 0x20
    return out.tobytes(), begin, end - 1


def bit_counts(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of shingles, repeats included, and how many of their hashes have each bit set (lowest bit first).

    Long texts are read in runs of words, so memory is bounded by the text itself.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, offsets = K.strings(column)
    starts, ends, first = K.spans(data, offsets, K.BLANK)
    words = np.diff(first)
    total = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    counts = np.zeros((len(total), BITS), np.int64)
    for lo in range(0, len(starts), RUN):
        hi = min(lo + RUN, len(starts))
        at = np.arange(lo, hi)
        text = np.searchsorted(first, at, side="right") - 1
        stop = first[text + 1]
        last = np.where(at + k <= stop, at + k - 1, np.where(at == first[text], stop - 1, -1))
        use = last >= 0
        if not use.any():
            continue
        text, at, last = text[use], at[use] - lo, last[use] - lo
        top = int(last.max()) + 1
        joined, begin, end = _joined(data, starts[lo : lo + top], ends[lo : lo + top])
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
        head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[text[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    return total, counts


def fingerprint(column: pa.Array, k: int) -> np.ndarray:
    """uint64 of each text; 0 without words."""
    total, counts = bit_counts(column, k)
    one = 2 * counts > total[:, None]
    return np.packbits(one, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: Column, text: Column, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""
    bound_batches(docs.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint(batch.column(1), words).view(np.int64))], ["doc_id", "fp"])

    return docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(K.tidy(run), "doc_id bigint, fp bigint")


def part_count(classes: int, tile: int) -> int:
    """The least number of parts for which a cell in the middle holds about four tiles."""
    return next((p for p in SPREAD if classes <= 4 * tile * SPREAD[p]), max(SPREAD))


def cell(fp: Column, parts: int) -> Column:
    """The population counts of all parts as the digits of one number."""
    width = BITS // parts
    out = F.lit(0).cast("long")
    for p in range(parts):
        part = F.shiftrightunsigned(fp, p * width)
        if parts > 1:
            part = part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out * (width + 1) + F.bit_count(part)
    return out


@cache
def steps(parts: int, radius: int) -> np.ndarray:
    """int8, steps x parts: all ways to change counts by no more than the radius in sum, of a way and its opposite one only; first, no change."""
    out = [(0,) * parts]

    def changes(n: int, left: int) -> Iterator[tuple[int, ...]]:
        if n == 0:
            yield ()
            return
        for by in range(1, left - n + 2):
            for rest in changes(n - 1, left - by):
                yield from ((by, *rest), (-by, *rest))

    for n in range(1, min(parts, radius) + 1):
        for places in combinations(range(parts), n):
            for by in changes(n, radius):
                if by[0] > 0:
                    step = [0] * parts
                    for place, b in zip(places, by, strict=True):
                        step[place] = b
                    out.append(tuple(step))
    return np.array(out, np.int8)


def neighbours(cells: np.ndarray, parts: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the cells at all ``steps`` from it that exist, and whose they are."""
    base = BITS // parts + 1
    digits = cells[:, None] // base ** np.arange(parts - 1, -1, -1, dtype=np.int64) % base
    moves = steps(parts, radius).astype(np.int64)
    there = digits[:, None, :] + moves[None, :, :]
    own, step = np.nonzero(((there >= 0) & (there < base)).all(axis=2))
    by = moves @ base ** np.arange(parts - 1, -1, -1, dtype=np.int64)
    return cells[own] + by[step], own


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the nodes 0 to n - 1 that connect what the links (i, j) connect: every node with the least of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            at = np.flatnonzero(label != np.arange(n))
            return at, label[at]
        label = new


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (of numbers 0 .. in left, then right) that differ in no more bits than the radius."""
    n = len(left)
    found_i, found_j = [], []
    for lo in range(0, n, rows):
        i, j = np.nonzero(np.bitwise_count(left[lo : lo + rows, None] ^ right[None, :]) <= radius)
        if len(i):
            i, j = spanning(i + lo, j + n, n + len(right))
            found_i.append(i)
            found_j.append(j)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(found_i), np.concatenate(found_j), n + len(right))


def links(classes: DataFrame, radius: int = 3, tile: int = 2048, parts: int | None = None) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` of ``classes``, distinct ones, that differ in no more bits than the radius."""
    bound_batches(classes.sparkSession, 4)
    parts = parts or part_count(classes.count(), tile)
    celled = classes.select("fp", cell(F.col("fp"), parts).alias("cell"))
    sizes = materialize(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles")), "cells")
    dealt = celled.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).alias("tile"), "fp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each tile from rows sorted by tile."""
        key, held = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["cell", "tile", "data"])

        for batch in batches:
            c, t, fp = (batch.column(i).to_numpy() for i in range(3))
            heads = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])) if len(c) else []
            for lo, hi in zip(heads, [*heads[1:], len(c)], strict=True):
                if (c[lo], t[lo]) != key:
                    if key is not None:
                        yield row()
                    key, held = (c[lo], t[lo]), []
                held.append(fp[lo:hi].copy())
        if key is not None:
            yield row()

    tiles = dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile").mapInArrow(K.tidy(pack), "cell bigint, tile bigint, data binary")
    tiles = materialize(tiles, "tiles")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, number = (batch.column(i).to_numpy() for i in range(2))
            there, own = neighbours(cells, parts, radius)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(cells[own]), pa.array(number[own])], ["cell", "from", "number"])

    # a tile visits the tiles of cells on one side of its own, and of its own cell those that come no earlier
    trips = tiles.select("cell", "tile").mapInArrow(K.tidy(visits), 'cell bigint, `from` bigint, number bigint').join(sizes, "cell")
    trips = trips.select("cell", "from", "number", F.explode(F.sequence(F.when(F.col("cell") == F.col("from"), F.col("number")).otherwise(F.lit(0).cast("long")), F.col("tiles") - 1)).alias("tile"))
    visitors = trips.join(tiles.select(F.col("cell").alias("from"), F.col("tile").alias("number"), F.col("data").alias("x")), ["from", "number"])
    meetings = visitors.join(tiles.withColumnRenamed("data", "y"), ["cell", "tile"]).select("x", "y")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                i, j = near_pairs(left.view(np.uint64), right.view(np.uint64), radius)
                both = np.concatenate([left, right])
                a, b = both[i], both[j]
                keep = a != b
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return materialize(meetings.mapInArrow(K.tidy(meet), "a bigint, b bigint"), "near")


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, words: int = 3, radius: int = 3, tile: int = 2048, parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row.

    Words are what blanks separate, A-Z read as a-z; shingles of ``words``
    words count with repeats, and a text with fewer words is one shingle.  Null,
    empty and blank texts have the fingerprint 0, linked like any other.
    component_id is the least doc_id that links reach; kept marks its rows.
    Rows are linked by their texts: rows with the same doc_id and different
    texts lie in the components of their texts.  Rows with a null doc_id take
    no part: they have a fingerprint, no component, and are kept.
    """
    prints = materialize(fingerprints(docs, doc_id, text, words), "prints")
    classes = materialize(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    found = components(links(classes, radius, tile, parts))
    named = materialize(classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "class_id", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_print = materialize(named.join(least, "component").select("fp", "component_id"), "least")
    out = prints.join(by_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
