"""Connected components of a distributed edge table by alternating large-star and small-star steps.

Minima are aggregated and joined back to the edges, so a node with very many neighbours is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, scratch: Scratch, tag: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component. edges: long columns u and v, any order.

    Rows with a null end and loops are left out. Each round is written to the shared folder, and rounds stop when nothing moves.
    """
    now = scratch.save(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0")
    mark = _mark(now)
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they are joined, so that the join's sides are plain exchanges, which Spark can split at a hub.
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-low")
        # Large star: each larger neighbour goes to the least of the neighbourhood. Small star: so do the smaller ones and the node.
        large = scratch.save(both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}-large")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{tag}-{k}")
        last, mark = mark, _mark(step)
        scratch.drop(f"{tag}-{k - 1}", f"{tag}-low", f"{tag}-large", f"{tag}-least")
        now = step
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
