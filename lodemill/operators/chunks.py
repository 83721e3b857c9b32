"""Chunking and packing of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_chunks(rows: DataFrame, group: list[str], order: list, size: int, overlap: int = 0) -> DataFrame:
    """A row for each row and chunk it is in: chunks of ``size``, ``overlap`` shared with the next.

    A trailing chunk of no more than ``overlap`` rows, all of which the chunk before has, is left out.
    """
    step = max(1, size - overlap)
    w = Window.partitionBy(*group)
    out = rows.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)).cast("int")
    out = out.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("pos") / step).cast("int"))))
    return out.where((F.col("chunk") == 0) | (F.col("_n") - F.col("chunk") * step > overlap)).drop("_n")


def typed_chunks(rows: DataFrame, kind: list[str], order: list, size: int) -> DataFrame:
    """Consecutive chunks of ``size`` rows within each kind."""
    w = Window.partitionBy(*kind).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def budget_fold(weights: Column, budget: float) -> Column:
    """Chunk number of each element of an array of weights: a chunk closes before it would exceed the
    budget; an element above the budget stands alone."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        x = x.cast("double")
        full = (acc["sum"] > 0) & (acc["sum"] + x > budget)
        nxt = F.when(full, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(F.concat(acc["ids"], F.array(nxt)).alias("ids"), nxt.alias("id"), F.when(full, x).otherwise(acc["sum"] + x).alias("sum"))

    return F.aggregate(weights, start, step, lambda acc: acc["ids"])


def budget_chunks(rows: DataFrame, group: list[str], order: str, weight: str, budget: float) -> DataFrame:
    """``group``, ``order``, ``weight`` and the chunk of each row, greedily filled in order.

    The rows of one group are folded in one array: group by document, not by corpus.
    """
    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, weight))).alias("_rows"))
    packed = packed.withColumn("_ids", budget_fold(F.transform("_rows", lambda r: r[weight]), budget))
    out = packed.select(*group, F.posexplode("_rows").alias("_i", "_r"), "_ids")
    return out.select(*group, F.col(f"_r.{order}").alias(order), F.col(f"_r.{weight}").alias(weight), F.col("_ids")[F.col("_i")].alias("chunk"))


def size_shards(rows: DataFrame, group: list[str], order: str, weight: str, target: float) -> DataFrame:
    """Shards cut as soon as their weight reaches ``target``."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        total = acc["sum"] + x.cast("double")
        cut = total >= target
        return F.struct(F.concat(acc["ids"], F.array(acc["id"])).alias("ids"), F.when(cut, acc["id"] + 1).otherwise(acc["id"]).alias("id"), F.when(cut, 0.0).otherwise(total).alias("sum"))

    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, weight))).alias("_rows"))
    packed = packed.withColumn("_ids", F.aggregate(F.transform("_rows", lambda r: r[weight]), start, step, lambda acc: acc["ids"]))
    out = packed.select(*group, F.posexplode("_rows").alias("_i", "_r"), "_ids")
    return out.select(*group, F.col(f"_r.{order}").alias(order), F.col(f"_r.{weight}").alias(weight), F.col("_ids")[F.col("_i")].alias("shard"))


def running_offsets(rows: DataFrame, group: list[str], order: list, size: str) -> DataFrame:
    """The sum of the sizes before each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def cross_references(items: DataFrame, refs: DataFrame) -> DataFrame:
    """(src_chunk, dst_chunk, n) of references (src, dst) between items (item, chunk) of different chunks."""
    a = items.select(F.col("item").alias("src"), F.col("chunk").alias("src_chunk"))
    b = items.select(F.col("item").alias("dst"), F.col("chunk").alias("dst_chunk"))
    return refs.join(a, "src").join(b, "dst").where("src_chunk <> dst_chunk").groupBy("src_chunk", "dst_chunk").agg(F.count("*").alias("n"))
