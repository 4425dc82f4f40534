"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import discard, written


def _lowest(directed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, low): every edge, of `most`, with the lowest of u and all its neighbours; and a table that it reads."""
    # Written, so that the join is one of two plain tables: Spark can split the edges of a node with very many.
    low = written(directed.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "lowest", most)
    return directed.join(low, "u"), low


def _large_star(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found, low = _lowest(both, 2 * most)
    return found.where("v > u and v != low").select(F.col("v").alias("u"), F.col("low").alias("v")), low


def _small_star(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    found, low = _lowest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), most)
    return found.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(found.select("u", F.col("low").alias("v"))), low


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (u long, v long); root is the component's lowest node.

    Each round is written to the shared folder. The rounds end when a round changes nothing; they are about as many as
    the logarithm of the longest chain. An edge of a node to itself gives that node as its own root; nulls are ignored.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null").distinct()
    alone = edges.where("u = v").select("u")
    now, seen = written(edges.where("u != v"), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == seen or not state[0]:
            break
        seen = state
        large, low = _large_star(now, state[0])
        small, lower = _small_star(large, state[0])  # a large star keeps each edge once at most
        before, now = now, written(small.distinct(), "edges", 2 * state[0])
        discard(before, low, lower)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select("v").union(alone).distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return members.union(roots).groupBy("node").agg(F.min("root").alias("root"))
