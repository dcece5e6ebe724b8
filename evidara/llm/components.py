"""Connected components over an edge table by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import checkpointed

#: Edges that a task takes at least: a table of fewer is one task's, and its rounds write no shuffle files.
EDGES = 50_000


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.hash("v", "u"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node that it reaches.

    Each round joins every neighbour to its centre's smallest neighbour and checkpoints the
    edges; it ends when a round changes nothing. A centre with very many neighbours meets
    a one-row-per-node table, so the join can be split. No round makes more edges than it gets,
    so a few edges do not go over as many partitions as the tables that they come from.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _signature(e)
    while before[0]:
        tasks = -(-before[0] // EDGES)
        both = e.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(down.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
