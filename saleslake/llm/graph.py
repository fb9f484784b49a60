"""Connected components of pairs, by alternating stars over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import discard, stored


def starred(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Links the neighbours of every node to the smallest of them and the node.

    ``both_ways``: over all neighbours, moving the larger ones; else over the smaller ones, moving these and the node."""
    arcs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else pairs
    least = stored(arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    met = arcs.join(least.hint("merge"), "a")
    if both_ways:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return stored(out.filter("a <> b").distinct())


def size_and_sum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node of its component and has a row too.

    In each round every node hands its neighbours to the smallest one (first over all neighbours, then over the smaller
    ones) until nothing changes: the number of rounds grows with the logarithm of the longest chain. Minima are
    combined in each task before the shuffle; both sides of the joins are stored, so a hub's partition can be split."""
    pairs = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    state = size_and_sum(pairs)
    while state[0]:
        large = starred(pairs, True)
        small = starred(large, False)
        discard(pairs)
        discard(large)
        pairs, before = small, state
        state = size_and_sum(pairs)
        if state == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


class Forest:
    """Union-find over the positions of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
