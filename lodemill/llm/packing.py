"""Best-fit packing of documents into token sequences under several capacities.

A sequence has a capacity of tokens, of documents and of attention cost (the sum of squared lengths).
Pieces are taken by falling length; each goes to the open sequence that has room in every capacity
and is left with the smallest weighted residual norm (or the largest weighted dot product of demand
and residual). Pieces are dealt to shards of a bounded number by row, whatever their key, and packed
there; the sequences that a shard leaves poorly filled are dealt and packed once more across shards.

Defined results: a null or empty text is the end id alone; a text longer than a sequence is cut, its
first piece taking the remainder; repeated rows and doc_ids are packed one by one; an empty table
gives no rows; rows with a null doc_id are packed like others; columns named sequence_id or offset are
replaced, other columns of ``pack``'s rows stay whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path
from .shared import cut, ship
from .token_files import encoded_batches

TOKENS = 2048
#: Pieces packed together by one task.
SHARD = 16_384


def cut_lengths(n: int, most: int = TOKENS) -> list[int]:
    """Lengths of the pieces of n ids: the remainder first, then full ones."""
    return ([n % most] if n % most else []) + [most] * (n // most)


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, most: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches):
        for rows, ids, off in encoded_batches(batches, tokenizer, end):
            doc, piece, start, length, crc = [], [], [], [], []
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            for d, a, z in zip(rows.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                at = 0
                for i, n in enumerate(cut_lengths(z - a, most)):
                    doc.append(d)
                    piece.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * (a + at) : 4 * (a + at + n)]))
                    at += n
            cols = (doc, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, by vector best-fit decreasing.

    The open bins are the first n columns of ``room``; a bin no piece fits any more gives its column up.
    """
    order = np.argsort(-length, kind="stable")
    cap, w = np.array(capacity, float), np.array(weights, float)
    scale = w / cap**2
    room = np.empty((3, len(length)))
    bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    open_, n, made = np.empty(len(length), np.int64), 0, 0
    least = float(length.min()) if len(length) else 0.0
    for i in order.tolist():
        size = float(length[i])
        need = (size, 1.0, size * size)
        if (need > cap).any():
            raise ValueError(f"a piece of {length[i]} tokens exceeds a capacity")
        fits = np.flatnonzero((room[0, :n] >= need[0]) & (room[1, :n] >= 1.0) & (room[2, :n] >= need[2]))
        if len(fits):
            tokens, documents, attention = room[0].take(fits), room[1].take(fits), room[2].take(fits)
            if score == "norm":
                tokens -= need[0]
                documents -= need[1]
                attention -= need[2]
                value = scale[0] * tokens * tokens + scale[1] * documents * documents + scale[2] * attention * attention
            else:
                value = -(scale[0] * need[0] * tokens + scale[1] * documents + scale[2] * need[2] * attention)
            k = int(fits[np.argmin(value)])
        else:
            k, n = n, n + 1
            open_[k], made = made, made + 1
            room[:, k] = cap
        bins[i], offset[i] = open_[k], cap[0] - room[0, k]
        room[:, k] -= need
        if room[0, k] < least or room[1, k] < 1:  # full: no piece fits any more
            n -= 1
            room[:, k], open_[k] = room[:, n], open_[n]
    return bins, offset


def pack(rows: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: float | None = None, weights=(1.0, 1e-4, 1e-4), score: str = "norm", shard: int = SHARD) -> DataFrame:
    """``rows`` (with a column length) with sequence_id and offset, which replace columns of these names.

    Capacities left out are the natural ones: no sequence has more documents than tokens, nor a cost
    above the square of its tokens. They weigh in the score all the same.
    """
    caps = (tokens, tokens if documents is None else documents, float(tokens) ** 2 if attention is None else attention)
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    shard_of, fill_of = (next(c for c in (f"{'_' * k}{name}" for k in range(1, 99)) if c not in names) for name in ("shard", "fill"))
    rows = cut(rows.select(*names))
    n = rows.count()

    def packed(df: DataFrame, groups: int, round_: int) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            length, group = table.column("length").to_numpy(), table.column(shard_of)[0].as_py()
            bins, offset = best_fit(length, caps, weights, score)
            fill = np.bincount(bins, weights=length)[bins] if len(bins) else bins
            out = table.select(names).append_column("sequence_id", pa.array((round_ << 62) + (group << 32) + bins))
            return out.append_column("offset", pa.array(offset)).append_column(fill_of, pa.array(fill, pa.float64()))

        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", sequence_id long, offset long, {fill_of} double"
        dealt = df.withColumn(shard_of, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        return dealt.groupBy(shard_of).applyInArrow(run, schema)

    first = cut(packed(rows, max(1, -(-n // shard)), 0))
    if n <= shard:
        return first.drop(fill_of)
    poor = F.col(fill_of) < 0.97 * tokens
    again = cut(first.where(poor).select(*names))
    m = again.count()
    return first.where(~poor).drop(fill_of).unionByName(packed(again, max(1, -(-m // shard)), 1).drop(fill_of))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path()))
