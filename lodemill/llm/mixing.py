"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a budget; a target stops
at twice its source's size and the excess is shared again. A source gives every document as often as
its target holds the whole source, and once more a selection whose words make up the remainder:
documents are counted by exact length, each length gives its share, and a bounded-knapsack programme
over the lengths left fits the remaining budget. Of a length's documents, those first by a seeded
hash are taken. Counts are grouped by hash bucket too, so that only one bucket of a length has to be
ranked; no window ever holds a whole length or source.

Defined results: a null or blank text has size 0 and is never taken; repeated rows count one by one;
rows with a null doc_id take part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, ship

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Least number of hash buckets of a length, and rows for which there is one more.
BUCKETS, RANKED = 64, 1 << 20
#: The remaining budget, in words, that the knapsack programme fits.
BUDGET = 1 << 16


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``totals`` (source, size) with target: shares of ``share`` times all sizes by weight, none above
    ``most`` times its source's size, the excess shared again by weight.

    Sources in code-point order, null last, weigh ``weights``, repeating. A source is full if its bound a
    unit of weight is below the common level; in the order of these bounds the level follows from the sums
    before, so two sorted passes over the sources' totals settle it, on no driver.
    """
    spark = totals.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = cut(totals.withColumn("weight", weight).withColumn("bound", (F.lit(most) * F.col("size")).cast("double")))
    sums = rows.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.sum("bound").alias("bound")).first()
    budget = share * (sums["size"] or 0)
    if not budget:
        return rows.select("source", "size", F.lit(0.0).alias("target"))
    full = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("full", F.coalesce(F.sum("bound").over(full), F.lit(0.0))).withColumn("spent", F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    level = (F.lit(budget) - F.col("full")) / (F.lit(sums["weight"]) - F.col("spent"))
    found = before.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("bound")).agg(F.min_by("level", F.struct(F.col("bound") / F.col("weight"), "spent"))).first()[0]
    target = F.col("bound") if found is None else F.least("bound", F.lit(found) * F.col("weight"))
    return rows.select("source", "size", target.alias("target"))


def fit_lengths(length: np.ndarray, count: np.ndarray, goal: int, budget: int = BUDGET) -> np.ndarray:
    """How many documents of each length to take, their words summing to ``goal`` or as near below as found."""
    length, count = length.astype(np.int64), count.astype(np.int64)
    total = int((length * count).sum())
    take = np.zeros(len(length), np.int64)
    if goal <= 0 or not total:
        return take
    bulk = goal - min(goal // 8, budget // 2)  # the rest is fitted
    take = np.array([int(c) * bulk // total for c in count], np.int64)
    left, free = goal - int((take * length).sum()), count - take
    for i in np.argsort(-length, kind="stable"):
        if left <= budget:
            break
        m = min(int(free[i]), max(0, left - budget // 2) // int(length[i]) if length[i] else 0)
        take[i] += m
        free[i] -= m
        left -= m * int(length[i])
    left = min(left, int((free * length).sum()))
    unit = max(1, -(-left // (64 * budget)))  # where only very long documents are left, in words rounded up
    words, left = length, left // unit
    length = -(-length // unit)
    by = np.full(left + 1, -1, np.int32)
    by[0] = -2
    parts: list[tuple[int, int]] = []
    for i in np.argsort(length, kind="stable"):
        have, step = int(free[i]), 1
        if not length[i] or length[i] > left:
            continue
        have = min(have, left // int(length[i]))
        while have > 0 and by[left] == -1:
            k = min(step, have)
            d = k * int(length[i])
            fresh = np.flatnonzero((by[d:] == -1) & (by[: left + 1 - d] != -1)) + d if d <= left else np.zeros(0, int)
            by[fresh] = len(parts)
            parts.append((int(i), k))
            have, step = have - k, step * 2
        if by[left] != -1:
            break
    s = int(np.flatnonzero(by != -1)[-1])
    while s:
        i, k = parts[by[s]]
        take[i] += k
        s -= k * int(length[i])
    assert (take * words).sum() <= goal
    return take


def nearest(length: np.ndarray, count: np.ndarray, take: np.ndarray, goal: int) -> np.ndarray:
    """``take``, with one document more where that comes nearer to ``goal`` from above."""
    gap = goal - int((take * length).sum())
    free = np.flatnonzero((count > take) & (length > 0) & (length < 2 * gap))
    if len(free):
        take = take.copy()
        take[free[np.argmin(np.abs(length[free] - gap))]] += 1
    return take


def mixed(docs: DataFrame, seed: int = 42, weights=WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, size, source_size, target, copies and taken for each row of ``docs`` (doc_id, text, source)."""
    spark = docs.sparkSession
    ship(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    rows = docs.select(*keep, F.col("source").alias("_source"), size.alias("size"), key.alias("_h"))
    if "text" in keep:  # texts stay out of the checkpoint
        light = cut(rows.select("_source", "size", "_h"))
    else:
        light = rows = cut(rows)
    buckets = F.pmod("_h", F.lit(max(BUCKETS, -(-light.count() // RANKED))))
    rows, light = rows.withColumn("_b", buckets), light.withColumn("_b", buckets)
    totals = targets(light.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("size")), weights, share, most)
    shares = cut(totals.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target"))

    cells = light.groupBy("_source", "size", "_b").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    plan = lengths.join(shares, lengths["_source"].eqNullSafe(shares["_source"])).drop(shares["_source"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        total, goal = int(pdf["source_size"].iloc[0]), int(pdf["target"].iloc[0])
        whole = goal // total if total else 0
        pdf["whole"] = whole
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        pdf["more"] = nearest(size, n, fit_lengths(size, n, goal - whole * total), goal - whole * total)
        return pdf[["_source", "size", "source_size", "target", "whole", "more"]]

    plan = cut(plan.groupBy("_source").applyInPandas(choose, "_source string, size long, source_size long, target double, whole long, more long"))
    before = F.sum("n").over(Window.partitionBy("_source", "size").orderBy("_b")) - F.col("n")
    cells = cells.withColumn("before", before)
    a, b = cells.alias("a"), plan.alias("b")
    cells = a.join(b, F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a.size") == F.col("b.size")))
    need = F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("n"))
    cells = cells.select("a._source", "a.size", "a._b", "n", "source_size", "target", "whole", need.alias("need"))
    x, y = rows.alias("x"), cells.alias("y")
    out = x.join(y, F.col("x._source").eqNullSafe(F.col("y._source")) & (F.col("x.size") == F.col("y.size")) & (F.col("x._b") == F.col("y._b")))
    out = out.select(*(f"x.{c}" for c in keep), "x._source", "x.size", "x._h", "x._b", "source_size", "target", "whole", "need", "n")
    edge = (F.col("need") > 0) & (F.col("need") < F.col("n"))
    w = Window.partitionBy("_source", "size", "_b").orderBy("_h", *keep)
    ranked = out.where(edge).withColumn("extra", (F.row_number().over(w) <= F.col("need")).cast("long"))
    sure = out.where(~edge).withColumn("extra", (F.col("need") > 0).cast("long"))
    out = sure.unionByName(ranked).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
