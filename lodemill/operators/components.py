"""Connected components of an undirected graph: local forests, alternating stars, one last forest.

Every partition first replaces its edges by a forest of stars, which is as wide as its vertices. While
more edges are left than one task may hold, rounds of large and small stars follow, cut by a checkpoint
in the shared folder; a vertex with very many edges is joined by broadcast there, of which there can
only be few. The last edges, at most ``GATHER``, are settled in one task. No vertex or edge reaches the
driver.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (of 16 bytes) that one task settles.
GATHER = 1 << 21
#: A vertex with more than this share of all edges is broadcast: there are at most twice its inverse.
HOT = 1 / 5000


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in the folder of ``spark.checkpoint.dir`` (in local mode one is set if unset)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


def _forest(edges: DataFrame) -> DataFrame:
    """Of each partition of ``edges`` (u, v): every vertex but the smallest of its component, with that."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def settle(u, v):
            ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
            a, b = at[: len(u)], at[len(u) :]
            parent = np.arange(len(ids))
            while True:
                x, y = parent[a], parent[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
            below = np.flatnonzero(parent != np.arange(len(ids)))
            return ids[below], ids[parent[below]]

        held, n = [], 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= 1 << 22:  # fold what has come so far
                held = [settle(*(np.concatenate(x) for x in zip(*held)))]
                n = len(held[0][0])
        if held:
            u, v = settle(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], ["u", "v"])

    return edges.mapInArrow(run, edges.select("u", "v").schema)


def _with_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """``edges`` with the ``m`` of their u; vertices of over ``hot`` edges, few for certain, by broadcast."""
    loud = F.broadcast(least.where(F.col("n") > hot).select("u", F.col("m").alias("loud")))
    marked = edges.join(loud, "u", "left")
    calm = marked.where("loud is null").drop("loud").join(least.where(F.col("n") <= hot).select("u", "m"), "u")
    return calm.unionByName(marked.where("loud is not null").withColumnRenamed("loud", "m"))


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", gather: int = GATHER) -> DataFrame:
    """(node, component): each vertex of an edge, and the smallest vertex reachable from it.

    Edges with a null end are ignored; a loop makes its vertex a component.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    found = checkpointed(_forest(e.where("u <> v")))
    before, n = None, found.count()
    while n > gather:
        hot = max(1000, int(n * HOT))
        found = checkpointed(_forest(_small_star(checkpointed(_large_star(found, hot).where("u <> v").distinct()), hot).where("u <> v").distinct()))
        mark = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before, n = mark, mark[0]
    else:
        found = checkpointed(_forest(found.repartition(1)))
    roots = found.select(F.col("v").alias("node")).unionByName(loops).distinct()
    found = found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = roots.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
