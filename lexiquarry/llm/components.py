"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no node's neighbours are ever collected; a
hub's links are spread over tasks. Nodes are of any ordered type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise, release


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("k"))
    return join_spread(both.where("b > a"), least, ["a"], "k", total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
    moved = join_spread(down, least, ["a"], "k", total=n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``links (a, b)``: the least id that each reaches.

    Null ends and loops count for nothing; without links the result is empty.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if found == state or found.n == 0:
            break
        state, before = found, edges
        edges = materialise(_small_star(_large_star(edges, found.n).where("a <> b").distinct(), 2 * found.n).where("a <> b").distinct())
        release(before)
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
