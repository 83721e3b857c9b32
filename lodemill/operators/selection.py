"""Filters, lookups, summaries and small distributions over columnar rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rich_enough(rows: DataFrame, tokens: str, least: int, kinds: str, wanted: list[str] | None) -> DataFrame:
    """Rows of ``least`` tokens or more whose array ``kinds`` meets ``wanted``; without wanted kinds all meet."""
    out = rows.where(F.col(tokens) >= least)
    return out.where(F.arrays_overlap(F.col(kinds), F.array(*map(F.lit, wanted)))) if wanted else out


def by_kind(rows: DataFrame, kind: str, value: str, confidence: str | None = None, least: float = 0.0) -> DataFrame:
    """Rows of one kind, from a confidence of ``least`` on; rows without a confidence go where one is asked."""
    out = rows.where(F.col(kind) == value)
    return out.where(F.col(confidence) >= least) if confidence else out


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of the one row of ``table`` under their key; nulls if there is none."""
    return rows.join(table.dropDuplicates([key]), key, "left")


def capable(models: DataFrame, provider: str, capability: str) -> DataFrame:
    """Models (provider, capabilities) of a provider that have a capability."""
    return models.where((F.col("provider") == provider) & F.array_contains("capabilities", capability))


def bounds_violation(axes: list[Column], low: float, high: float) -> Column:
    """How far the worst axis lies outside [low, high]; 0 inside."""
    return F.greatest(F.lit(0.0), *(F.greatest(low - a, a - high) for a in axes))


def in_box(axes: list[Column], low: list[float], high: list[float]) -> Column:
    """Whether a point lies in a closed box."""
    out = F.lit(True)
    for a, lo, hi in zip(axes, low, high):
        out = out & a.between(lo, hi)
    return out


def faces_inside(faces: DataFrame, vertices: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(faces with their three vertices among ``vertices`` (group, id), numbered anew from 0 by id; those numbers)."""
    numbers = vertices.select(*group, "id").distinct()
    numbers = numbers.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy("id")) - 1)
    out = faces
    for v in ("a", "b", "c"):
        out = out.join(numbers.select(*group, F.col("id").alias(v), F.col("number").alias(f"_{v}")), [*group, v])
    return out.select(*(c for c in faces.columns if c not in ("a", "b", "c")), *(F.col(f"_{v}").alias(v) for v in ("a", "b", "c"))), numbers


def box_summary(rows: DataFrame, group: list[str], axes: list[str], refs: str) -> DataFrame:
    """group, least and greatest of every axis, the box's volume, and mean, greatest and sum of the reference counts."""
    volume = F.lit(1.0)
    for a in axes:
        volume = volume * (F.max(a) - F.min(a))
    sums = [F.min(a).alias(f"min_{a}") for a in axes] + [F.max(a).alias(f"max_{a}") for a in axes]
    return rows.groupBy(*group).agg(*sums, volume.alias("volume"), F.avg(refs).alias("mean_refs"), F.max(refs).alias("most_refs"), F.sum(refs).alias("refs"))


def hierarchy(entities: DataFrame, group: list[str], kinds: dict[str, list[str]]) -> DataFrame:
    """group and, for each name, the sorted ids of the entities of its types."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("type").isin(*types), F.col("id")))).alias(name) for name, types in kinds.items()]
    return entities.groupBy(*group).agg(*lists)


def histogram(rows: DataFrame, group: list[str], value: str, bins: int, clip: float | None = None) -> DataFrame:
    """group, n, mean and population deviation of the raw values, and counts of ``bins`` equal bins between the
    least and greatest (clipped) value, the last bin closed; a single value fills the bins around it as a half."""
    x = F.col(value) if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(value)))
    rows = rows.where(F.col(value).isNotNull()).withColumn("_x", x)
    stats = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    flat = F.col("low") == F.col("high")
    low, high = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))
    stats = stats.withColumns({"low": low, "high": high})
    at = F.least(F.floor((F.col("_x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    counts = rows.select(*group, "_x").join(stats.select(*group, "low", "high"), group).groupBy(*group, at.alias("bin")).agg(F.count("*").alias("n_bin"))
    filled = counts.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n_bin"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0)))
    return stats.join(filled, group).withColumn("counts", values).drop("_m")


def categories(rows: DataFrame, category: str, item: str) -> DataFrame:
    """category, n and the sorted items under it."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items"))


def preserved(before: DataFrame, after: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """group and the share of its distinct relationships in ``before`` that ``after`` has too."""
    own = before.select(*group, *key).distinct()
    kept = own.join(after.select(*group, *key).distinct().withColumn("_kept", F.lit(1)), [*group, *key], "left")
    return kept.groupBy(*group).agg((F.count("_kept") / F.count("*")).alias("rate"))


def collapse(rows: DataFrame, group: list[str], axes: list[tuple[str, str]], epsilon: float = 1e-10, apart: float = 1e-6) -> DataFrame:
    """group, mean and greatest displacement between original and new places (pairs of columns), and how many
    points share the cell of a new place with one whose original place was further off than ``apart``.

    A cell with one original place (up to ``apart`` on every axis) has collapsed nothing.
    """
    moved = F.sqrt(sum(((F.col(a) - F.col(b)) ** 2 for a, b in axes), F.lit(0.0)))
    cell = [F.floor(F.col(b) / epsilon + 0.5).alias(f"_c{i}") for i, (_, b) in enumerate(axes)]
    rows = rows.select(*group, *(F.col(a).alias(f"_o{i}") for i, (a, _) in enumerate(axes)), *cell, moved.alias("_d"))
    spread = F.sqrt(sum(((F.max(f"_o{i}") - F.min(f"_o{i}")) ** 2 for i in range(len(axes))), F.lit(0.0)))
    cells = rows.groupBy(*group, *(f"_c{i}" for i in range(len(axes)))).agg(F.count("*").alias("n"), F.sum("_d").alias("s"), F.max("_d").alias("m"), spread.alias("w"))
    return cells.groupBy(*group).agg(F.sum("n").alias("points"), (F.sum("s") / F.sum("n")).alias("mean_moved"), F.max("m").alias("most_moved"), F.sum(F.when(F.col("w") > apart, F.col("n")).otherwise(0)).alias("collapsed"))


def children(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """src and its sorted children over the edges (src, dst, kind) of a kind."""
    own = edges if kind is None else edges.where(F.col("kind") == kind)
    return own.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("children"))


def root_order(nodes: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """group, id, position: nodes that no edge leads to by rising id, then the others by falling weight and id."""
    to = edges.select(*group, F.col("dst").alias("id")).distinct().withColumn("_in", F.lit(1))
    rows = nodes.join(to, [*group, "id"], "left")
    w = Window.partitionBy(*group).orderBy(F.col("_in").isNotNull(), F.when(F.col("_in").isNull(), F.col("id")), F.desc("weight"), F.desc("id"))
    return rows.select(*group, "id", (F.row_number().over(w) - 1).alias("position"))


def packed_batches(rows: DataFrame, group: list[str], order: str, size: str, cap: int) -> DataFrame:
    """group, the order column and the batch of every row not above ``cap``: a batch closes before it would exceed it."""
    own = rows.where(F.col(size) <= cap)
    items = own.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("_a"))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<o:bigint,b:bigint>>").alias("out"))

    def step(s, x):
        closes = (s["total"] > 0) & (s["total"] + x["s"] > cap)
        batch = s["batch"] + closes.cast("long")
        return F.struct(batch.alias("batch"), F.when(closes, x["s"]).otherwise(s["total"] + x["s"]).alias("total"), F.concat(s["out"], F.array(F.struct(x["o"].cast("long").alias("o"), batch.alias("b")))).alias("out"))

    done = items.select(*group, F.explode(F.aggregate("_a", start, step, lambda s: s["out"])).alias("_x"))
    return done.select(*group, F.col("_x.o").alias(order), F.col("_x.b").alias("batch"))


def removed_copies(rows: DataFrame, key: str, name: str, signature: str, body: str) -> DataFrame:
    """Rows that share their name and their signature or body hash with one of a smaller key."""
    first = [rows.groupBy(F.col(name).alias("_n"), F.col(h).alias("_h")).agg(F.min(key).alias("_first")) for h in (signature, body)]
    out = rows
    for i, (f, h) in enumerate(zip(first, (signature, body))):
        out = out.join(f.select("_n", F.col("_h").alias(f"_h{i}"), F.col("_first").alias(f"_f{i}")), (F.col(name) == F.col("_n")) & (F.col(h) == F.col(f"_h{i}"))).drop("_n", f"_h{i}")
    return out.where((F.col("_f0") < F.col(key)) | (F.col("_f1") < F.col(key))).drop("_f0", "_f1")
