"""Near duplicates by circulant MinHash, banding and exact verification.

One permutation places a document's word shingles in a circle of 2**20 cells; one table of ranks, read
from that cell on, gives all signature coordinates (coordinate k is the table turned by k). Documents
with equal shingle sets become one node. Nodes that share a band are joined to the bucket's smallest
node, never to each other, and the components of that graph are the candidate groups. Each group's
full sets are gathered once; links are confirmed on them, shingle for shingle. A shingle is 64 bits of
a hash of its words: two different ones among the n of a pair of texts meet with probability below
n**2 / 2**65.

Inside a group every pair of different components is settled: a pivot is compared with all members
that the size bound, the triangle inequality of the Jaccard distance and, in larger groups, their
rarest shingles leave possible, and pivots are taken until everything outside the largest component
has been one. Groups whose sets are too
large for one task go the same way in rounds of Spark jobs (``_link_large``), without gathering them.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a null
doc_id takes no part (component null, kept); rows that share a doc_id are one vertex; repeated rows
are kept or not alike; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import LOWER, U, blocks, cut, gram_hashes, mix, partitions, ragged, ship, span_hashes, utf8, word_spans

CELLS = 1 << 20
BANDS, ROWS = 20, 4
WORDS, PERCENT = 5, 85
#: Bytes of shingle sets that one task may gather.
GATHER = 192 << 20

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _circle(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and windows of the ranking permutation written twice over its ends."""
    if seed not in _tables:
        rng = np.random.default_rng(seed)
        place, rank = rng.permutation(CELLS).astype(np.uint32), rng.permutation(CELLS).astype(np.uint32)
        k = BANDS * ROWS
        _tables[seed] = place, np.lib.stride_tricks.sliding_window_view(np.concatenate((rank, rank[: k - 1])), k)
    return _tables[seed]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS coordinates of a non-empty set of 64-bit shingles."""
    place, turned = _circle()
    at = place[(shingles & U(CELLS - 1)).astype(np.int64)]
    out = turned[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        np.minimum(out, turned[at[i : i + 4096]].min(axis=0), out=out)
    return out


def shingle_sets(b: np.ndarray, off: np.ndarray, k: int = WORDS):
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(b, off)
    h = span_hashes(LOWER[b], starts, ends)
    gram = gram_hashes(h, k)
    for i in range(len(off) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= k:
            s = np.sort(gram[lo : hi - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield gram_hashes(h[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) int64 keys of (documents, BANDS * ROWS) coordinates."""
    v = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        out = mix(out + v[:, :, j])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set, null if empty) and bands, of doc_id and text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            b, off = utf8(batch.column(1))
            size, ids, sigs = [], [], []
            for i, j in blocks(off):
                for s in shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i]):
                    size.append(len(s))
                    ids.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                    if len(s):
                        sigs.append(signature(s))
            keys = _band_keys(np.array(sigs, np.uint32).reshape(-1, BANDS * ROWS))
            at = np.cumsum([0, *(BANDS * (n > 0) for n in size)])
            bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), bands], ["doc_id", "n_shingles", "set_id", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


# ------------------------------------------------------------------------------------- verification


def linked(inter, a, b, percent: int = PERCENT):
    return 100 * inter >= percent * (a + b - inter)


#: Sets from which on partners are looked up by their rare shingles, and pivots whose distances are kept.
RARE, PIVOTS = 64, 16


class Partners:
    """For each of some sets, those that may be linked with it.

    Linked sets share ``percent`` hundredths of the larger; so, under one order of all shingles, rarest
    first, each has a shared one among its first size - ceil(percent * size / 100) + 1.
    """

    def __init__(self, cell: np.ndarray, off: np.ndarray, percent: int):
        size, m = np.diff(off), len(off) - 1
        row = np.repeat(np.arange(m), size)
        order = np.lexsort((cell, np.bincount(cell)[cell], row))
        place = np.arange(len(cell)) - np.repeat(off[:-1], size)
        first = order[place < np.repeat(size - -(-percent * size // 100) + 1, size)]
        self.cell, self.row = cell[first], row[first]
        self.at = np.searchsorted(self.row, np.arange(m + 1))
        self.by = np.argsort(self.cell, kind="stable")
        self.sorted = self.cell[self.by]

    def of(self, x: int) -> np.ndarray:
        own = self.cell[self.at[x] : self.at[x + 1]]
        lo, hi = np.searchsorted(self.sorted, own, "left"), np.searchsorted(self.sorted, own, "right")
        return self.row[self.by[ragged(self.by, lo, hi - lo)]]


def components_of_sets(flat: np.ndarray, off: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest linked index for each set flat[off[i]:off[i+1]]; exact."""
    m = len(off) - 1
    size, label = np.diff(off), np.arange(m)
    if m < 2:
        return label
    _, cell = np.unique(flat, return_inverse=True)
    flag = np.zeros(int(cell.max()) + 1 if len(cell) else 1, bool)
    done, seen = np.zeros(m, bool), []
    far = 1 - percent / 100 + 1e-9
    partners = Partners(cell, off, percent) if m >= RARE and len(cell) else None
    count = np.ones(m, np.int64)  # members of each label
    main, where = 0, 0
    first = True
    while True:
        if first:
            x = 0
        else:
            while where < m and (done[where] or label[where] == main):
                where += 1
            if where == m:
                break
            x = where
        done[x] = True
        fits = np.ones(m, bool) if first else (label != label[x]) & ~done
        if partners is not None and not first:
            rare = np.zeros(m, bool)
            rare[partners.of(x)] = True
            fits &= rare
        if not first:
            fits &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
            for d in seen:
                fits &= ~(np.abs(d - d[x]) > far)
        fits[x] = False
        first = False
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        flag[cell[off[x] : off[x + 1]]] = True
        if len(at) == m - 1:
            hit = np.concatenate(([0], np.cumsum(flag[cell])))
            inter = (hit[off[1:]] - hit[off[:-1]])[at]
        else:
            own = cell[ragged(cell, off[at], size[at])]
            hit = np.concatenate(([0], np.cumsum(flag[own])))
            end = np.cumsum(size[at])
            inter = hit[end] - hit[end - size[at]]
        flag[cell[off[x] : off[x + 1]]] = False
        if len(seen) < PIVOTS and (partners is None or len(at) == m - 1):
            d = np.full(m, np.nan)
            d[at], d[x] = 1 - inter / (size[at] + size[x] - inter), 0
            seen.append(d)
        near = np.unique(label[at[linked(inter, size[at], size[x], percent)]])
        if len(near):
            low = min(int(near.min()), int(label[x]))
            gone = np.isin(label, near) | (label == label[x])
            label[gone] = low
            count[low] = int(gone.sum())
            if count[low] > count[main] or main in near or main == label[x]:
                main = low if count[low] >= count[main] or label[main] != main else main
                where = 0
    return label


def _groups(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """(node, component) of the rows (bucket, grp, node, shingles) of one bucket."""
    grp, node = table.column("grp").to_numpy(), table.column("node").to_numpy()
    raw, off = utf8(table.column("shingles"))
    order = np.lexsort((node, grp))
    out = node.copy()
    cuts = np.flatnonzero(np.concatenate(([True], grp[order][1:] != grp[order][:-1]))).tolist() + [len(order)]
    for a, z in zip(cuts[:-1], cuts[1:]):
        rows = order[a:z]
        sets = [raw[off[r] : off[r + 1]].view(np.uint64) if (off[r] % 8 == 0) else np.frombuffer(raw[off[r] : off[r + 1]].tobytes(), np.uint64) for r in rows]
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        label = components_of_sets(np.concatenate(sets), at, percent)
        out[rows] = node[rows][label]
    return pa.table({"node": node, "component": out})


def _with_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, grp, bucket) with the shingles of the text of that document."""

    def run(batches):
        for batch in batches:
            b, off = utf8(batch.column(3))
            for i, j in blocks(off):
                sets = [s.tobytes() for s in shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())], ["node", "grp", "bucket", "shingles"])

    text = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null")
    return nodes.join(text, "node").select("node", "grp", "bucket", "text").mapInArrow(run, "node long, grp long, bucket long, shingles binary")


def _link_large(members: DataFrame, percent: int = PERCENT, hubs: int = 64) -> DataFrame:
    """Links (src, dst) that settle every component of the groups of ``members`` (node, grp, shingles).

    Each round compares up to ``hubs`` nodes of a group, none of them in its largest component yet,
    with all its members; it ends when every other node has been a hub.
    """
    spark = members.sparkSession
    members = cut(members)
    links = spark.createDataFrame([], "src long, dst long")
    tried = spark.createDataFrame([], "node long")

    def compare(batches):
        for batch in batches:
            src, dst = [], []
            for node, raw, pivots in zip(batch.column("node").to_pylist(), batch.column("shingles"), batch.column("pivots")):
                own = np.frombuffer(raw.as_py(), np.uint64)
                for p in pivots.as_py():
                    other = np.frombuffer(p["shingles"], np.uint64)
                    inter = len(np.intersect1d(own, other, assume_unique=True))
                    if node != p["node"] and linked(inter, len(own), len(other), percent):
                        src.append(node)
                        dst.append(p["node"])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    while True:
        label = members.select("grp", "node").distinct().join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = label.groupBy("grp", "component").count().groupBy("grp").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        left = label.join(main, "grp").where("component <> main").join(tried, "node", "left_anti")
        pick = left.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node"))).where(F.col("r") <= hubs).select("grp", "node")
        pick = cut(pick)
        if pick.isEmpty():
            return links
        pivots = members.join(F.broadcast(pick), ["grp", "node"]).groupBy("grp").agg(F.collect_list(F.struct("node", "shingles")).alias("pivots"))
        found = members.join(pivots, "grp").select("node", "shingles", "pivots").mapInArrow(compare, "src long, dst long")
        links, tried = cut(links.unionByName(found)), cut(tried.unionByName(pick.select("node")))


def near_duplicates(docs: DataFrame, gather: int = GATHER, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text); pairs whose
    Jaccard similarity is ``percent`` hundredths or more are linked."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    sig = cut(signed(docs))
    sets = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "bands", "n_shingles")).alias("one"))
    sets = cut(sets.select("set_id", F.col("one.doc_id").alias("node"), F.col("one.bands").alias("bands"), F.col("one.n_shingles").alias("n")))
    keys = sets.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    near = connected_components(keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")))
    near = cut(near.select("node", F.col("component").alias("grp")))
    weight = sets.select("node", "n").join(near, "node").groupBy("grp").agg((8 * F.sum("n")).alias("bytes"))
    weight = cut(weight)
    total, largest = weight.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    n = max(4 * partitions(spark), -(-total // (gather // 4)))
    bucket = F.pmod(F.xxhash64("grp"), F.lit(n))
    small = near.join(weight.where(F.col("bytes") <= gather).select("grp"), "grp", "left_semi")
    found = _with_sets(docs, small.withColumn("bucket", bucket)).groupBy("bucket").applyInArrow(lambda t: _groups(t, percent), "node long, component long")
    if largest > gather:
        large = near.join(weight.where(F.col("bytes") > gather).select("grp"), "grp", "left_semi")
        members = _with_sets(docs, large.withColumn("bucket", F.lit(0).cast("long"))).drop("bucket")
        found = found.unionByName(connected_components(_link_large(members, percent)))
    found = found.groupBy("node").agg(F.min("component").alias("component"))
    label = sets.select("set_id", "node").join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_id").join(label, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
