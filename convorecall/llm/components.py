"""Connected components as joins and partial aggregates; no edge list ever meets in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from convorecall.llm.scratch import written


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Edges as a written table, and their number and a hash of them all, observed while they are written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")), "edges")
    return table, (int(seen.get["n"]), int(seen.get["x"] or 0))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each node of an undirected graph.

    ``edges`` has bigint columns ``a`` and ``b``; direction, repeated rows and loops do not matter and nulls are left
    out. Returns ``node, component`` for nodes with an edge to another node. Alternates the large-star and small-star
    steps, which need a number of rounds that grows with the logarithm of the longest path.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e, seen = _kept(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not seen[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e, now = _kept(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
