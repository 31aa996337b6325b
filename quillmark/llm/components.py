"""Connected components of a link table.

Up to ``one_task`` links are solved by a union-find in one task: the count is
checked first, so what that task holds is bounded.  More links are contracted:
each round every node points to its least neighbour, the links are renamed by
these pointers and repeated or inner links go; the rounds end when no more
than ``one_task`` links are left.  Every step of a round is an aggregation with
partial sums or a join of two stored tables, so that a node with very many
links can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import bound_batches, materialize


class Forest:
    """Union-find over numbers; a set's name is its least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, nodes = Forest(), set()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(a, b)
            nodes.update((a, b))
    order = sorted(nodes)
    yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array([forest.find(x) for x in order], pa.int64())], ["node", "component"])


def components(links: DataFrame, one_task: int = 1_000_000) -> DataFrame:
    """(node, component) for all nodes of ``links(a, b)``; a component's name is its least node.

    Repeated links and links from a node to itself are allowed.
    """
    bound_batches(links.sparkSession)
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    rounds: list[DataFrame] = []
    nodes = None
    while edges.count() > one_task:
        if nodes is None:
            nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e"))
        up = both.groupBy(F.col("e.v").alias("v")).agg(F.min("e.u").alias("u")).select("v", F.least("v", "u").alias("up"))
        up = materialize(up, "pointers")
        rounds.append(up)
        left = edges.join(up.select(F.col("v").alias("a"), F.col("up").alias("x")), "a")
        both_ = left.join(up.select(F.col("v").alias("b"), F.col("up").alias("y")), "b")
        edges = materialize(both_.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    solved = materialize(edges.coalesce(1).mapInArrow(_solve, "node bigint, component bigint"), "names")
    if nodes is None:
        return solved

    def follow(now: DataFrame, up: DataFrame) -> DataFrame:
        # joined on the name so far; nodes that are settled have no pointer in later rounds
        new = now.join(up.select(F.col("v").alias("component"), "up"), "component", "left")
        return materialize(new.select("node", F.coalesce("up", "component").alias("component")), "names")

    last = solved.select(F.col("node").alias("v"), F.col("component").alias("up"))
    return reduce(follow, [*rounds, last], nodes)
