"""Space partitions: octree cells, uniform grids, k-means, and vertex clusters by proximity."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .spatial import point_pairs


def octree(points: DataFrame, group: str, most: int, depth: int = 8, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``points`` with a cell: the path of half-space bits from the group's box down to the first cell that
    holds at most ``most`` points (or the depth). Cells are half-open, so a point is in one of them."""
    box = points.groupBy(group).agg(*(F.min(a).alias(f"_lo_{a}") for a in axes), *(F.max(a).alias(f"_hi_{a}") for a in axes))
    rows = points.join(box, group)
    digit = lambda a, d: F.when(F.col(f"_hi_{a}") > F.col(f"_lo_{a}"), F.least(F.floor((F.col(a) - F.col(f"_lo_{a}")) / (F.col(f"_hi_{a}") - F.col(f"_lo_{a}")) * (1 << d)), F.lit((1 << d) - 1))).otherwise(0)
    names = [F.concat_ws(".", F.lit(str(d)), *(digit(a, d).cast("string") for a in axes)) for d in range(depth + 1)]
    rows = rows.withColumn("_cells", F.array(*names)).drop(*(f"_{s}_{a}" for s in ("lo", "hi") for a in axes))
    counts = rows.select(group, F.explode("_cells").alias("cell")).groupBy(group, "cell").agg(F.count("*").alias("_n"))
    small = counts.where((F.col("_n") <= most) | F.col("cell").startswith(f"{depth}."))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    first = keyed.select("_row", group, F.posexplode("_cells").alias("_d", "cell")).join(small.select(group, "cell"), [group, "cell"]).groupBy("_row").agg(F.min_by("cell", "_d").alias("cell"))
    return keyed.join(first, "_row").drop("_row", "_cells")


def grid(points: DataFrame, cells: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``points`` with the half-open cell of a uniform grid of ``cells`` by axis over the box of all."""
    box = points.agg(*(F.min(a).alias(f"_lo_{a}") for a in axes), *(F.max(a).alias(f"_hi_{a}") for a in axes))
    at = [F.when(F.col(f"_hi_{a}") > F.col(f"_lo_{a}"), F.least(F.floor((F.col(a) - F.col(f"_lo_{a}")) / (F.col(f"_hi_{a}") - F.col(f"_lo_{a}")) * cells), F.lit(cells - 1))).otherwise(0) for a in axes]
    number = reduce(lambda p, q: p * cells + q, at)
    return points.join(F.broadcast(box)).withColumn("cell", number).drop(*(f"_{s}_{a}" for s in ("lo", "hi") for a in axes))


def k_means(points: DataFrame, k: int, axes: tuple[str, ...] = ("x", "y", "z"), rounds: int = 100, seed: int = 42) -> DataFrame:
    """``points`` with the cluster of each."""
    rows = VectorAssembler(inputCols=list(axes), outputCol="_v").transform(points)
    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_v")


def proximity_clusters(points: DataFrame, id_: str, axes: list[str], radius: float) -> DataFrame:
    """(id, cluster): points linked within ``radius``, directly or through others, by the smallest id."""
    found = connected_components(point_pairs(points, id_, axes, radius), "a_id", "b_id")
    return points.select(F.col(id_).alias("node")).join(found, "node", "left").select(F.col("node").alias(id_), F.coalesce("component", "node").alias("cluster"))
