"""Mesh operators on facets (mesh, facet, v0, v1, v2: vertex ids) and vertices (mesh, vertex, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import triangle
from .components import connected_components


def edges(facets: DataFrame) -> DataFrame:
    """mesh, facet, a < b, and whether the facet runs the edge from a to b, for the three edges of each."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), (F.col(p) < F.col(q)).alias("up")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return facets.select("mesh", "facet", F.explode(pairs).alias("e")).select("mesh", "facet", "e.a", "e.b", "e.up")


def edge_counts(facets: DataFrame) -> DataFrame:
    return edges(facets).groupBy("mesh", "a", "b").agg(F.count("*").alias("n"), F.count_if("up").alias("up"))


def manifold(facets: DataFrame) -> DataFrame:
    """mesh, closed (every edge in 2 facets), manifold (no edge in more), boundary and non-manifold edges,
    consistent winding (2-facet edges run both ways)."""
    c = edge_counts(facets)
    return c.groupBy("mesh").agg(F.bool_and(F.col("n") == 2).alias("closed"), F.bool_and(F.col("n") <= 2).alias("manifold"), F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("non_manifold_edges"), F.bool_and((F.col("n") != 2) | (F.col("up") == 1)).alias("consistent_winding"))


def euler(facets: DataFrame) -> DataFrame:
    """mesh, V, E, F, the Euler characteristic and the genus max(0, (2 - chi) // 2)."""
    v = facets.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct().groupBy("mesh").agg(F.count("*").alias("V"))
    e = edge_counts(facets).groupBy("mesh").agg(F.count("*").alias("E"))
    f = facets.groupBy("mesh").agg(F.count("*").alias("F"))
    chi = F.col("V") - F.col("E") + F.col("F")
    return v.join(e, "mesh").join(f, "mesh").withColumn("euler", chi).withColumn("genus", F.greatest(F.lit(0), F.floor((2 - chi) / 2)))


def adjacency(facets: DataFrame) -> DataFrame:
    """mesh, f1 < f2: facets that share an edge. Edges in very many facets make pairs in the square of them."""
    e = edges(facets).select("mesh", "a", "b", "facet")
    other = e.select("mesh", "a", "b", F.col("facet").alias("f2"))
    return e.join(other, ["mesh", "a", "b"]).where("facet < f2").select("mesh", F.col("facet").alias("f1"), "f2").distinct()


def corners(facets: DataFrame, vertices: DataFrame) -> DataFrame:
    """Facets with the coordinates x0, y0, z0 ... of their three vertices."""
    for i in range(3):
        own = vertices.select("mesh", F.col("vertex").alias(f"v{i}"), *(F.col(a).alias(f"{a}{i}") for a in "xyz"))
        facets = facets.join(own, ["mesh", f"v{i}"])
    return facets


def facet_geometry(placed: DataFrame) -> DataFrame:
    """The facets of ``corners`` with centroid, normal, area and edge lengths."""
    p, q, r = ([F.col(f"{a}{i}") for a in "xyz"] for i in range(3))
    return placed.select("mesh", "facet", "v0", "v1", "v2", *(v.alias(k) for k, v in triangle(p, q, r).items()), *(F.col(f"{a}{i}") for i in range(3) for a in "xyz"))


def quality(geometry: DataFrame, poor: float = 5.0, high: float = 10.0, degenerate: float = 1e-10) -> DataFrame:
    """mesh: facet count, edge length and aspect ratio (longest by shortest edge) statistics, degenerate facets."""
    ratio = F.when(F.array_min("edges") > 0, F.array_max("edges") / F.array_min("edges"))
    g = geometry.withColumn("ratio", ratio)
    e = geometry.select("mesh", F.explode("edges").alias("e")).groupBy("mesh").agg(F.min("e").alias("edge_min"), F.max("e").alias("edge_max"), F.avg("e").alias("edge_mean"), F.stddev_pop("e").alias("edge_std"))
    out = g.groupBy("mesh").agg(F.count("*").alias("facets"), F.avg("ratio").alias("ratio_mean"), F.max("ratio").alias("ratio_max"), F.count_if(F.col("ratio") > poor).alias("poor"), F.count_if(F.col("ratio") > high).alias("high"), F.count_if(F.col("area") < degenerate).alias("degenerate"))
    return out.join(e, "mesh")


def area_and_volume(geometry: DataFrame) -> DataFrame:
    """mesh, surface area, and the volume enclosed (null unless every edge is in two facets)."""
    x = lambda i, a: F.col(f"{a}{i}")
    det = x(0, "x") * (x(1, "y") * x(2, "z") - x(1, "z") * x(2, "y")) - x(0, "y") * (x(1, "x") * x(2, "z") - x(1, "z") * x(2, "x")) + x(0, "z") * (x(1, "x") * x(2, "y") - x(1, "y") * x(2, "x"))
    sums = geometry.groupBy("mesh").agg(F.sum("area").alias("area"), F.abs(F.sum(det / 6)).alias("v"))
    return sums.join(manifold(geometry).select("mesh", "closed"), "mesh").select("mesh", "area", F.when(F.col("closed"), F.col("v")).alias("volume"))


def dihedral_angles(geometry: DataFrame) -> DataFrame:
    """mesh, a, b, angle between the normals of the two facets of each two-facet edge."""
    n = geometry.select("mesh", "facet", "normal")
    pairs = edges(geometry).groupBy("mesh", "a", "b").agg(F.min("facet").alias("f1"), F.max("facet").alias("f2"), F.count("*").alias("n")).where("n = 2 and f1 <> f2")
    p = pairs.join(n.withColumnsRenamed({"facet": "f1", "normal": "n1"}), ["mesh", "f1"]).join(n.withColumnsRenamed({"facet": "f2", "normal": "n2"}), ["mesh", "f2"])
    d = F.aggregate(F.zip_with("n1", "n2", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return p.select("mesh", "a", "b", F.acos(F.greatest(F.least(d, F.lit(1.0)), F.lit(-1.0))).alias("angle"))


def segments(facets: DataFrame, angles: DataFrame | None = None, most: float | None = None) -> DataFrame:
    """mesh, facet, segment: facets connected over shared edges (of an angle of at most ``most``)."""
    if angles is not None:
        kept = angles.where(F.col("angle") <= most).select("mesh", "a", "b")
        e = edges(facets).join(kept, ["mesh", "a", "b"], "left_semi")
        links = e.groupBy("mesh", "a", "b").agg(F.min("facet").alias("f1"), F.max("facet").alias("f2"))
    else:
        links = adjacency(facets)
    name = lambda f: F.concat_ws("/", "mesh", F.lpad(F.col(f).cast("string"), 12, "0"))
    found = connected_components(links.select(name("f1").alias("src"), name("f2").alias("dst")))
    out = facets.select("mesh", "facet", name("facet").alias("node")).join(found, "node", "left")
    return out.select("mesh", "facet", F.coalesce("component", "node").alias("segment"))


def merge_vertices(facets: DataFrame, vertices: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(facets, vertices) with vertices of equal rounded coordinates merged into the smallest id, facets
    renumbered and degenerate ones dropped."""
    key = [F.round(a, digits).alias(f"_{a}") for a in "xyz"]
    first = vertices.groupBy("mesh", *key).agg(F.min("vertex").alias("to"))
    mapping = vertices.select("mesh", "vertex", *key).join(first, ["mesh", "_x", "_y", "_z"]).select("mesh", "vertex", "to")
    for i in range(3):
        facets = facets.join(mapping.select("mesh", F.col("vertex").alias(f"v{i}"), F.col("to").alias(f"_t{i}")), ["mesh", f"v{i}"])
    facets = facets.select("mesh", "facet", *(F.col(f"_t{i}").alias(f"v{i}") for i in range(3))).where("v0 <> v1 and v1 <> v2 and v2 <> v0")
    kept = vertices.join(mapping.where("vertex = to").select("mesh", "vertex"), ["mesh", "vertex"], "left_semi")
    return facets, kept


def angle_defect(geometry: DataFrame) -> DataFrame:
    """mesh, vertex, 2 pi minus the sum of the facet angles at the vertex."""
    l = lambda i: F.col("edges")[i]  # noqa: E731, E741  edges: 01, 02, 12
    angle = lambda a, b, c: F.acos(F.greatest(F.least((a * a + b * b - c * c) / (2 * a * b), F.lit(1.0)), F.lit(-1.0)))
    ok = geometry.where(F.array_min("edges") > 0)
    at = F.array(F.struct(F.col("v0").alias("vertex"), angle(l(0), l(1), l(2)).alias("a")), F.struct(F.col("v1").alias("vertex"), angle(l(0), l(2), l(1)).alias("a")), F.struct(F.col("v2").alias("vertex"), angle(l(1), l(2), l(0)).alias("a")))
    return ok.select("mesh", F.explode(at).alias("c")).groupBy("mesh", "c.vertex").agg((2 * F.pi() - F.sum("c.a")).alias("defect"))
