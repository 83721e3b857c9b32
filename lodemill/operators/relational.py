"""Filters, joins, ordering, splits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def filtered(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all (column, op, value); a condition on an absent column or with an unknown op passes."""
    for col, op, value in conditions:
        if col in df.columns and op in _OPS:
            df = df.where(_OPS[op](F.col(col), F.lit(value)))
    return df


def scan(df: DataFrame, columns: list[str] | None = None, remove: list[str] = (), filters: list = (), seed: int | None = None, key: str | None = None, world: int = 1, rank: int = 0, take: int | None = None) -> DataFrame:
    """A dataset scan: filter, project, shuffle by a seeded hash of ``key``, take this worker's share, cut.

    Filters run before the projection, so they reach the file scan and may use other columns.
    """
    df = filtered(df, filters)
    if world > 1:
        df = df.where(F.pmod(F.xxhash64(F.lit(seed or 0), F.col(key)), F.lit(world)) == rank)
    if seed is not None:
        df = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    if take is not None:
        df = df.limit(take)
    return (df.select(*columns) if columns else df).drop(*remove)


def best_of(df: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of each group, ties to the smallest ``tie``."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def split_of(key: Column, val: int, test: int, parts: int = 100) -> Column:
    """test, val or train by an integer key: a multiplicative hash modulo ``parts``, test first."""
    h = F.pmod(key * F.lit(2654435761) + 40503, F.lit(1 << 32))
    bucket = F.floor(h / (1 << 16)) % parts
    return F.when(bucket < test, "test").when(bucket < test + val, "val").otherwise("train")


def validation(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, and of those that break each rule."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))


def first_match(column: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The name of the first substring that ``column`` contains."""
    return reduce(lambda acc, kv: F.when(column.contains(kv[0]), kv[1]).otherwise(acc), reversed(cases), F.lit(default))
