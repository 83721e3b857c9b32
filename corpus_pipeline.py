"""The corpus pipeline: rules, near duplicates, repeated passages, target mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and gives it, read again, to the next. All stages but the last return the columns of
``documents``; other columns are left out by the first. Near duplicates are documents whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more.

Defined results: a null, empty or blank text fails the base rule and goes; rows with a null doc_id pass
the stages that compare documents by id untouched; rows that share a doc_id stay or go together as near
duplicates and do not repeat one another; ties go to the smallest doc_id; a document the mix takes twice
is two rows; without labels only the base rule rejects; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm import mixing, near_dup, packing, quality_rules, suffix_dedup
from lodemill.llm.bpe import default_path
from lodemill.llm.shared import cut, shared_dir
from lodemill.llm.token_files import delete_at_exit

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    docs = docs.select(*COLUMNS)
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality_rules.judged(docs, rules).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates."""
    docs = docs.select(*COLUMNS)
    gone = near_dup.near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that one with a smaller doc_id has."""
    return suffix_dedup.without_repeats(docs.select(*COLUMNS))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    own = docs.select(*COLUMNS)
    copies = mixing.mixed(own, keep=COLUMNS).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in token sequences."""
    return packing.pack(packing.pieces(docs, default_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("target_mix", target_mix),
    ("best_fit_packing", pack),
]

#: SQL can express neither the learned rules nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            delete_at_exit(spark, path)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
