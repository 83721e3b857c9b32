"""Token ids of documents in Parquet files, written and read selectively.

A dataset is a folder of Parquet files in ascending doc_id order. Each row holds a document's ids as a
list, their number, the number of its file part and of the ids before it in that part. Ids are
dictionary encoded, or delta encoded (format 2 pages without a dictionary); row groups and pages have
set sizes and Parquet's page indexes, so a reader that asks for a range of doc_id or for metadata only
skips the other pages and columns.

Defined results: a null or empty text is the end id alone; rows with a null doc_id come first; rows
that share a doc_id stand side by side in an order fixed by their text; an empty table makes a
dataset without rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .shared import partitions, shared_dir, ship, utf8

#: Documents encoded by one call.
CHUNK = 512


def encoded_batches(batches, path: str, end: int | None):
    """(batch slice, ids, offsets) of Arrow batches whose last column is the text."""
    own = encoder(path)
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            ids, off = own.encode(part.column(part.num_columns - 1).to_pylist(), end)
            yield part, ids, off


def delete_at_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, *, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, files: int | None = None) -> None:
    """Write the dataset of ``docs`` (doc_id, text) to ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    spark = docs.sparkSession
    ship(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ordered = ordered.repartitionByRange(files or 2 * partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for rows, ids, off in encoded_batches(batches, tokenizer, end):
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(n, part), pa.int32()), pa.array(before + off[:-1], pa.int64()), pa.array(np.diff(off), pa.int64()), lists], ["doc_id", "part", "before", "n_tokens", "ids"])
            before += int(off[-1])

    writer = ordered.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids array<int>").write.mode("error")
    writer = writer.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.dictionary.page.size", 4 << 20)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Columns of a dataset; ``start`` is the number of ids of all documents before.

    Only the files' totals, a row for each part written, are added up in one place and broadcast.
    """
    rows = spark.read.schema("doc_id long, part int, before long, n_tokens long, ids array<int>").parquet(path)
    if "start" in columns:
        parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
        parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("start_of_part"))
        rows = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("start_of_part") + F.col("before"))
    return rows.select(*columns)


def with_crc(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """``rows`` with ids_crc32, of the ids as little-endian unsigned 32-bit integers, instead of ``ids``."""
    keep = [c for c in rows.columns if c != ids]

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            off = col.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != ids) + ", ids_crc32 long"
    return rows.mapInArrow(run, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path())
    back = read_tokens(spark, path, ("doc_id", "start", "ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    return with_crc(back).select("doc_id", "start", "n_tokens", "ids_crc32")
