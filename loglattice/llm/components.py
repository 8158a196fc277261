"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import durable, join_crowded


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs); the root is the least node reachable.

    Large-star and small-star steps in turn: each hangs a node's neighbours onto
    the least node it sees, until nothing moves. The number of edges never
    grows, a step is two aggregations with map-side combining and two joins, and
    each result is checkpointed. Nodes with very many neighbours are broadcast
    (``join_crowded``). No edges give no rows.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, total = state, 2 * state[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_crowded(both.where("b > a"), least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = join_crowded(large, least, "a", "n", total)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = durable(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    else:
        raise RuntimeError("components have not settled")
    roots = now.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
