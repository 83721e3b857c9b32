"""Graph operators on edge lists (src, dst). Loops over joins, cut by checkpoints; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed, connected_components

__all__ = ["connected_components", "degrees", "k_hop", "reachable", "shortest_paths", "levels", "roll_up"]


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of every vertex of an edge."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "forward") -> DataFrame:
    """(node, hop): vertices within ``hops`` of a seed (node), with the least number of hops."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = {"forward": edges.select("src", "dst"), "backward": back, "both": edges.select("src", "dst").unionByName(back)}[direction]
    found = front = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        front = front.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        front = checkpointed(front.join(found.select("node"), "node", "left_anti").withColumn("hop", F.lit(h)))
        found = found.unionByName(front)
    return found


def reachable(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst, depth): all pairs on a directed path, by fewest edges; a vertex is not its own."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    found = front = checkpointed(e.withColumn("depth", F.lit(1)))
    for depth in range(2, rounds + 1):
        step = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid")
        step = step.where("src <> dst").select("src", "dst").distinct().join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        front = checkpointed(step.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"paths longer than {rounds} edges")


def shortest_paths(edges: DataFrame, seeds: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, hops, path): the first shortest directed path, by vertex order, from a seed (node)."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    found = front = seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.array("node").alias("path"))
    for h in range(1, rounds + 1):
        step = front.select(F.col("node").alias("src"), "path").join(e, "src").select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(found.select("node"), "node", "left_anti")
        front = checkpointed(step.select("node", F.lit(h).alias("hops"), "path"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"paths longer than {rounds} edges")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 for vertices nothing refers to, else -1."""
    return degrees(edges).select("node", F.when(F.col("in_degree") == 0, 0).otherwise(-1).alias("level"))


def roll_up(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, descendants, depth) of every vertex that has descendants."""
    return reachable(edges, rounds).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("descendants"), F.max("depth").alias("depth"))
