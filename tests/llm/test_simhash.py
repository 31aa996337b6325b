"""SimHash near-dedup against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmark.llm import queries, simhash

SMALL = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, k=3):
    words = BLANK.findall((text or "").translate(LOW))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Least id reachable of every (id, print) with an id, by comparing all pairs."""
    kinds = sorted({p for i, p in prints if i is not None})
    name = {p: p for p in kinds}

    def find(p):
        while name[p] != p:
            p = name[p]
        return p

    values = np.array(kinds, np.uint64)
    for p in kinds:
        for q in values[np.bitwise_count(values ^ np.uint64(p)) <= radius].tolist():
            a, b = find(p), find(q)
            name[max(a, b)] = min(a, b)
    least = {}
    for i, p in prints:
        if i is not None:
            r = find(p)
            least[r] = min(least.get(r, i), i)
    return {(i, p): least[find(p)] for i, p in prints if i is not None}


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three four"), (None, None), (5, "one two three four"), (5, "one two three four"), (5, "something else altogether here"), (6, "Éa" * 100_000 + " end"), (7, "x"), (8, "X"), (9, "x y \x0b z"), (10, "a b"), (11, " A\rB\n"), (12, "w " * 70_000 + "x y z"), (13, "\x00 \x1c b c d")]


def odd(spark):
    return spark.createDataFrame([(i, t, "f", 1, 2) for i, t in ODD], "doc_id long, text string, fingerprint string, component_id int, fp int")


def test_fingerprints_are_the_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    column = pa.array([r.text for r in rows] + [t for _, t in ODD])
    want = [plain_print(r.text) for r in rows] + [plain_print(t) for _, t in ODD]
    assert simhash.fingerprint(column, 3).tolist() == want
    assert simhash.fingerprint(column.slice(5, 60), 3).tolist() == want[5:65]
    assert simhash.fingerprint(pa.array([], pa.string()), 3).tolist() == []


def test_query_is_the_plain_one(spark):
    got = queries.QUERIES["op11_tiled_simhash_neardup"](spark, SMALL).collect()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    want = plain_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", want[i, p]) for i, p in prints)
    assert len({r.component_id for r in got}) < len(got)


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark), F.col("doc_id"), F.col("text")).collect()
    prints = [(i, plain_print(t)) for i, t in ODD]
    want = plain_components(prints)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((i, f"{p:016x}", want.get((i, p))) for i, p in prints), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    empty = simhash.near_duplicates(odd(spark).limit(0), F.col("doc_id"), F.col("text"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id", "kept"]


@pytest.mark.parametrize(("parts", "tile"), [(1, 50), (2, 7), (4, 3), (8, 1), (16, 5), (None, 2048)])
def test_links_do_not_depend_on_parts_and_tiles(spark, parts, tile):
    """Chains at distances 1 to 4, a crowded corner of the cube and noise."""
    rng = random.Random(5)
    prints = {0, 1, 2**64 - 1, 2**64 - 2}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
    prints |= {rng.getrandbits(9) << 20 | 7 << 40 for _ in range(80)}
    table = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    found = simhash.components(simhash.links(table, 3, tile, parts)).collect()
    name = {r.node % 2**64: r.component for r in found}
    want = plain_components([(p, p) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(name.get(p, ("alone", p)), set()).add(want[p, p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_steps_and_spanning():
    def count(parts, radius):
        """Whole-number points within the radius, by recursion over the parts."""
        return 1 if parts == 0 else sum(count(parts - 1, radius - abs(x)) for x in range(-radius, radius + 1))

    for parts in (1, 2, 4, 8):
        for radius in (0, 1, 3):
            moves = simhash.steps(parts, radius)
            assert 2 * len(moves) - 1 == count(parts, radius) and not moves[0].any()
            every = {tuple(m) for m in moves.tolist()} | {tuple(m) for m in (-moves).tolist()}
            assert len(every) == 2 * len(moves) - 1 and max(np.abs(moves).sum(axis=1)) == (radius if parts else 0)
    i, j = simhash.spanning(np.array([0, 5, 3, 3]), np.array([5, 2, 4, 4]), 7)
    assert dict(zip(i.tolist(), j.tolist(), strict=True)) == {5: 0, 2: 0, 4: 3}
    assert [simhash.part_count(n, 2048) for n in (0, 10**5, 10**6, 10**9, 10**11)] == [1, 1, 4, 8, 16]


def test_a_crowd_gives_few_links(spark):
    """All pairs of 4,096 fingerprints in twelve bits: far fewer links than pairs leave the tasks."""
    crowd = spark.range(4096).select(F.col("id").alias("fp"))
    found = simhash.links(crowd, 3, 512)
    assert found.count() < 4096 * 64
    assert {r.component for r in simhash.components(found).collect()} == {0}
