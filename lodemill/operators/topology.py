"""Operators on parsed exchange-structure entities: rows (file, id, type, refs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Category by the first substring of an entity type that matches: fixed values.
CATEGORIES = (
    ("FACE", "topology"), ("EDGE", "topology"), ("VERTEX", "topology"), ("SHELL", "topology"), ("LOOP", "topology"), ("BREP", "solid"), ("SOLID", "solid"),
    ("SURFACE", "geometry"), ("CURVE", "geometry"), ("LINE", "geometry"), ("CIRCLE", "geometry"), ("PLANE", "geometry"), ("POINT", "geometry"), ("DIRECTION", "geometry"), ("PLACEMENT", "geometry"),
    ("TOLERANCE", "annotation"), ("DIMENSION", "annotation"), ("PRODUCT", "product"), ("ASSEMBLY", "product"),
)
#: Euler characteristics a closed solid of few handles has: fixed values.
EULER_OK = (2, 0, -2, -4)


def category(kind: Column) -> Column:
    out = F.lit("other")
    for part, name in reversed(CATEGORIES):
        out = F.when(kind.contains(part), name).otherwise(out)
    return out


def references(entities: DataFrame, dangling: bool = False) -> DataFrame:
    """(file, src, dst): references to entities that exist, or those to ids that do not."""
    r = entities.select("file", F.col("id").alias("src"), F.explode("refs").alias("dst"))
    return r.join(entities.select("file", F.col("id").alias("dst")).distinct(), ["file", "dst"], "left_anti" if dangling else "left_semi").select("file", "src", "dst")


def summary(entities: DataFrame) -> DataFrame:
    """file, entities, roots (nothing refers to them), leaves, dominant category and counts by type."""
    to = references(entities).select("file", F.col("dst").alias("id")).distinct().withColumn("_in", F.lit(True))
    e = entities.join(to, ["file", "id"], "left")
    flat = e.groupBy("file").agg(F.count("*").alias("entities"), F.count_if(F.col("_in").isNull()).alias("roots"), F.count_if(F.coalesce(F.size("refs"), F.lit(0)) <= 0).alias("leaves"))
    kinds = entities.groupBy("file", "type").agg(F.count("*").alias("n")).groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    top = entities.groupBy("file", category(F.col("type")).alias("c")).agg(F.count("*").alias("n")).groupBy("file").agg(F.max_by("c", F.struct("n", "c")).alias("category"))
    return flat.join(kinds, "file").join(top, "file")


def representation(entities: DataFrame) -> DataFrame:
    """file, solids, shells, faces, edges, vertices, Euler characteristic, genus, kind of representation."""
    n = lambda p: F.count_if(F.col("type").rlike(p))
    c = entities.groupBy("file").agg(n("SOLID|BREP").alias("solids"), n("SHELL").alias("shells"), n("^(ADVANCED_)?FACE(_SURFACE)?$").alias("faces"), n("^EDGE_CURVE$").alias("edges"), n("^VERTEX_POINT$").alias("vertices"))
    chi = F.col("vertices") - F.col("edges") + F.col("faces")
    kind = F.when(F.col("solids") > 0, "solid").when(F.col("shells") > 0, "surface").when(F.col("edges") > 0, "wireframe").otherwise("points")
    return c.withColumn("euler", chi).withColumn("genus", F.greatest(F.lit(0), F.floor((2 - chi) / 2))).withColumn("kind", kind)


def validated(entities: DataFrame, listed: int = 10) -> DataFrame:
    """file, Euler characteristic and whether it is one of a closed solid, dangling references (count, and
    the first by id), watertight (closed shells and no open ones), valid (none dangling)."""
    loose = references(entities, dangling=True)
    first = loose.select("file", "dst").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("dst"))).where(F.col("_r") <= listed)
    first = first.groupBy("file").agg(F.array_sort(F.collect_list("dst")).alias("dangling_ids"))
    counts = loose.groupBy("file").agg(F.count("*").alias("dangling"))
    tight = entities.groupBy("file").agg((F.bool_or(F.col("type") == "CLOSED_SHELL") & ~F.bool_or(F.col("type") == "OPEN_SHELL")).alias("watertight"))
    out = representation(entities).select("file", "euler").withColumn("euler_ok", F.col("euler").isin(*EULER_OK)).join(tight, "file").join(counts, "file", "left").join(first, "file", "left")
    return out.withColumn("dangling", F.coalesce("dangling", F.lit(0))).withColumn("valid", F.col("dangling") == 0)


#: Weights of entity types in their importance, others count 0.4: fixed values.
TYPE_WEIGHTS = {"MANIFOLD_SOLID_BREP": 1.0, "CLOSED_SHELL": 0.9, "OPEN_SHELL": 0.85, "FACE_SURFACE": 0.7, "ADVANCED_FACE": 0.7, "EDGE_CURVE": 0.5, "ORIENTED_EDGE": 0.5, "VERTEX_POINT": 0.3, "CARTESIAN_POINT": 0.2}


def importance(entities: DataFrame, weights: dict[str, float] = TYPE_WEIGHTS, default: float = 0.4, levels: DataFrame | None = None) -> DataFrame:
    """file, id, importance: 0.5 of the type's weight, 0.3 of the connectivity (0.6 of the in-degree and 0.4 of
    the out-degree, by the file's greatest) and 0.2 of the level (file, id, level) by the file's greatest, or
    of a half where that is 0."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    r = references(entities)
    in_, out = (r.groupBy("file", F.col(end).alias("id")).agg(F.count("*").alias(n)) for end, n in (("dst", "n_in"), ("src", "n_out")))
    e = entities.select("file", "id", "type").join(in_, ["file", "id"], "left").join(out, ["file", "id"], "left")
    e = e.join(levels.select("file", "id", "level"), ["file", "id"], "left") if levels is not None else e.withColumn("level", F.lit(0))
    most = e.groupBy("file").agg(*(F.max(F.coalesce(n, F.lit(0))).alias(f"most_{n}") for n in ("n_in", "n_out", "level")))

    def share(n):
        return F.coalesce(F.col(n) / F.when(F.col(f"most_{n}") > 0, F.col(f"most_{n}")), F.lit(0.0))

    level = F.when(F.col("most_level") > 0, share("level")).otherwise(0.5)
    score = 0.5 * F.coalesce(F.try_element_at(table, F.col("type")), F.lit(default)) + 0.3 * (0.6 * share("n_in") + 0.4 * share("n_out")) + 0.2 * level
    return e.join(most, "file").select("file", "id", score.alias("importance"))


def rewritten(entities: DataFrame, ids: DataFrame, params: str = "params") -> DataFrame:
    """Entities with ``#n`` in their parameters replaced by the map ids (file, id, to); others stay."""
    pieces = F.split(F.regexp_replace(F.col(params), r"#(\d+)", "\u0001#$1\u0001"), "\u0001")
    rows = entities.select("*", F.posexplode_outer(pieces).alias("_i", "_p")).withColumn("_ref", F.when(F.col("_p").rlike(r"^#\d+$"), F.expr("substring(_p, 2)").cast("long")))
    own = ids.select(F.col("file").alias("_f"), F.col("id").alias("_ref"), F.col("to").alias("_to"))
    rows = rows.join(own.withColumnRenamed("_ref", "_k"), (F.col("file") == F.col("_f")) & (F.col("_ref") == F.col("_k")), "left")
    part = F.when(F.col("_to").isNotNull(), F.concat(F.lit("#"), F.col("_to").cast("string"))).otherwise(F.col("_p"))
    text = rows.groupBy("file", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", part.alias("s")))), lambda s: s["s"]), "").alias("_new"))
    return entities.join(text, ["file", "id"], "left").withColumn(params, F.col("_new")).drop("_new")


def subtree_chunks(ordered: DataFrame, key: str, tokens: str, budget: float) -> DataFrame:
    """Chunks of a depth-first order (key, position, depth, tokens): a subtree starts at depth 0, and within
    it a chunk closes before it would exceed the budget."""
    from .chunks import budget_chunks

    tree = F.sum((F.col("depth") == 0).cast("int")).over(Window.partitionBy(key).orderBy("position"))
    rows = ordered.withColumn("tree", tree)
    out = budget_chunks(rows, [key, "tree"], "position", tokens, budget)
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("tree", "chunk")) - 1
    return out.withColumn("chunk", number).drop("tree")
