"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sheetloom.session import materialize

EDGES_PER_FILE = 100_000
LEAST_FILES = 6


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    linked = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame, known: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with a fingerprint taken while writing.

    ``known`` is the number of edges of the round before; few edges go to few files.
    """
    if known is not None:
        edges = edges.coalesce(max(LEAST_FILES, known // EDGES_PER_FILE + 1))
    seen = Observation()
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("h")), "edges")
    return table, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``.

    The component is its smallest node.  Alternating star contraction: each
    round is two aggregates and two equi-joins, with no neighbour lists, and
    the number of rounds grows with the logarithm of the graph.  The smaller
    side of both joins has one row per node, so adaptive execution can split
    a node that has very many edges.

    ``max_rounds`` stops early: nodes then share a component only if they are
    connected, but connected nodes may still be apart.
    """
    current, before = _written(edges.select("u", "v").where("u <> v").distinct())
    done = 0
    while before[0] and (max_rounds is None or done < max_rounds):
        current, after = _written(_small_star(_large_star(current)), before[0])
        done += 1
        if after == before:
            break
        before = after
    least = current.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("component"))
    roots = current.select(F.least("u", "v").alias("node")).distinct()
    alone = roots.join(least.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti")
    return least.union(alone.withColumn("component", F.col("node")))
