"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of a bounded size. In a shard equal vectors are one vertex that lists its
rows. The graph starts from random edges and is built in two passes over the vertices in batches:
greedy searches from the medoid propose neighbours, relaxed pruning keeps those no kept neighbour is
closer to by the factor alpha, and reverse edges are added, a full vertex being pruned alike; many
vertices are pruned side by side. Queries come in blocks that go to every shard; a beam search runs
over the shard's graph, many queries side by side, and the exact distances of the shards' answers are
merged by query.

Searches run on the shard's vectors less their mean, over their largest component, and on differences,
so neither a common offset nor the scale costs precision; scores are of the original vectors.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null id. Rows are told apart by row, not by id:
each row whose id is asked is a query of its own, and other rows of its id are answers like all others.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, ship

DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Vectors of a shard, and queries of a block.
SHARD, BLOCK_OF_QUERIES = 4096, 1024


def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(float32 vectors to search, what was taken off, and what the rest was divided by) of finite doubles."""
    if not len(v):
        return v.astype(np.float32), np.zeros(v.shape[1]), 1.0
    most = float(np.abs(v).max()) or 1.0
    middle = (v / most).mean(axis=0)
    x = v / most - middle
    spread = float(np.abs(x).max()) or 1.0
    return (x / spread).astype(np.float32), middle, most * spread


def placed(q: np.ndarray, middle: np.ndarray, scale: float, most: float) -> np.ndarray:
    """Queries as ``centred`` places the vectors."""
    return ((q / most - middle) / (scale / most)).astype(np.float32)


def _distances(x: np.ndarray, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of q[row[i]] and x[at[i]]."""
    d = x.take(at, axis=0)
    d -= q.take(row, axis=0)
    return np.einsum("id,id->i", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, squared distances) of the beam of each query, nearest first; -1 fills up."""
    n, width = len(q), graph.shape[1]
    at = np.full((n, beam + width), -1, np.int32)
    dist = np.full((n, beam + width), np.inf, np.float32)
    open_ = np.zeros((n, beam + width), bool)
    at[:, 0], open_[:, 0] = start, True
    dist[:, 0] = _distances(x, q, np.arange(n), np.full(n, start))
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        k = np.argmax(open_[live, :beam], axis=1)  # beams are sorted: the first open one is the nearest
        open_[live, k] = False
        new = graph[at[live, k]]
        fresh = new >= 0
        fresh &= ~seen[live[:, None], np.where(fresh, new, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], new[r, c]] = True
        d = np.full(new.shape, np.inf, np.float32)
        d[r, c] = _distances(x, q, live[r], new[r, c])
        at[live, beam:], dist[live, beam:], open_[live, beam:] = new, d, fresh
        changed = live[d.min(axis=1) < dist[live, beam - 1]]
        order = np.argsort(dist[changed], axis=1, kind="stable")
        for a in (dist, at, open_):
            a[changed] = np.take_along_axis(a[changed], order, 1)
        live = live[open_[live, :beam].any(axis=1)]
    at = np.where(np.isfinite(dist), at, -1)
    return at[:, :beam], dist[:, :beam]


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each vertex p[i] among cand[i] (-1: none), nearest first."""
    out = np.full((len(p), degree), -1, np.int32)
    for i in range(0, len(p), 256):
        own, c = p[i : i + 256], np.sort(cand[i : i + 256], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == own[:, None]] = -1
        none = c < 0
        v = x[np.where(none, 0, c)] - x[own][:, None, :]  # places as seen from p
        d = np.where(none, np.inf, np.einsum("pcd,pcd->pc", v, v))
        order = np.argsort(d, axis=1, kind="stable")
        c, d, v = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        square = np.einsum("pcd,pcd->pc", v, v)
        between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        between *= alpha**2
        alive, kept, rows = np.isfinite(d), np.zeros(len(own), np.int64), np.arange(len(own))
        for j in range(c.shape[1]):
            take = alive[:, j] & (kept < degree)
            if not take.any():
                continue
            r = rows[take]
            out[i + r, kept[r]] = c[r, j]
            kept[r] += 1
            alive[r] &= between[r, j] > d[r]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7, batch: int = 256) -> tuple[np.ndarray, int]:
    """(neighbours as rows of vertices, -1 fills up; the start vertex). A vertex gathers up to half as many
    reverse edges again as ``degree`` before it is pruned."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    width = degree + degree // 2
    graph = np.full((n, width), -1, np.int32)
    if n > 1:
        first = min(degree // 2, n - 1)
        graph[:, :first] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, first))) % n
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            p = order[i : i + batch]
            found, _ = beam_search(x, graph, start, x[p], beam)
            kept = robust_prune(x, p, np.concatenate((found, graph[p]), axis=1), degree, a)
            graph[p, :degree], graph[p, degree:] = kept, -1
            r, c = np.nonzero(kept >= 0)
            u, v = kept[r, c], p[r]
            known = (graph[u] == v[:, None]).any(axis=1)
            u, v = u[~known], v[~known]
            by = np.argsort(u, kind="stable")
            u, v = u[by], v[by]
            first = np.searchsorted(u, u)
            place = (graph[u] >= 0).sum(axis=1) + np.arange(len(u)) - first
            fits = place < width
            wide = np.unique(u[~fits])
            calm = fits & ~np.isin(u, wide)
            graph[u[calm], place[calm]] = v[calm]
            if len(wide):
                over = ~calm & np.isin(u, wide)
                uu, vv = u[over], v[over]
                at = np.searchsorted(wide, uu)
                place = np.arange(len(uu)) - np.searchsorted(uu, uu)
                more = np.full((len(wide), int(place.max()) + 1), -1, np.int32)
                more[at, place] = vv
                kept = robust_prune(x, wide, np.concatenate((graph[wide], more), axis=1), degree, a)
                graph[wide, :degree], graph[wide, degree:] = kept, -1
    return graph, start


def _clean(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v, row) of the rows that take part; ``row`` tells rows apart."""
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return cut(rows.where(F.size("v") == (size[0] if size else 0)).withColumn("row", F.monotonically_increasing_id()))


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors if "row" in vectors.columns else vectors.withColumn("row", F.col("vec_id"))


def build_index(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row (shard, dims, start, ids, rows, first, vectors, graph) for each shard of ``rows`` (vec_id, v, and
    row where ids do not tell rows apart).

    ids and rows and their original vectors are in the order of vertices; first[k] is where vertex k's begin.
    """
    ship(rows.sparkSession)
    n = rows.count()
    shards = max(1, -(-n // shard))

    def run(table: pa.Table) -> pa.Table:
        ids, row = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.lexsort((row, ids))
        ids, row, v = ids[order], row[order], v[order] + 0.0  # -0.0 is 0.0
        _, kinds, which = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        distinct, by = v[kinds], np.argsort(which, kind="stable")
        first = np.searchsorted(which[by], np.arange(len(distinct) + 1))
        graph, start = build_graph(centred(distinct)[0])
        out = (int(table.column("_shard")[0].as_py()), v.shape[1], start, ids[by].astype("<i8").tobytes(), row[by].astype("<i8").tobytes(), first.astype("<i8").tobytes(), distinct.tobytes(), graph.astype("<i4").tobytes())
        return pa.table([pa.array([x]) for x in out], names=["shard", "dims", "start", "ids", "rows", "first", "vectors", "graph"])

    dealt = _rows(rows).withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt = dealt.repartitionByRange(shards, "_shard")  # a task for each shard: their cost is in the graph, not the bytes
    return cut(dealt.groupBy("_shard").applyInArrow(run, "shard long, dims long, start long, ids binary, rows binary, first binary, vectors binary, graph binary"))


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM * 2, block: int = BLOCK_OF_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score and query_row of the k nearest found for each of ``queries`` (vec_id, v, row).

    Blocks of queries are sent to the shards, which stay where they are; each answers every block, as
    one row of k answers a query; the queries are a stated set, and no pair of a query and a candidate
    is made but for those answers.
    """
    spark = queries.sparkSession
    n, shards = queries.count(), index.count()
    blocks = max(1, -(-n // block))
    ship(spark)

    def pack(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy()
        out = (int(table.column("_block")[0].as_py()), *(table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "row")), v.astype("<f8").tobytes())
        return pa.table([pa.array([x]) for x in out], names=["block", "query_ids", "query_rows", "query_vectors"])

    dealt = _rows(queries).withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    packed = dealt.groupBy("_block").applyInArrow(pack, "block long, query_ids binary, query_rows binary, query_vectors binary")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                ids, rows, first = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows", "first"))
                v = np.frombuffer(row["vectors"]).reshape(-1, dims)
                graph = np.frombuffer(row["graph"], "<i4").reshape(len(v), -1)
                qid, qrow, q = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["query_rows"], "<i8"), np.frombuffer(row["query_vectors"], "<f8").reshape(-1, dims)
                x, middle, scale = centred(v)
                most = float(np.abs(v).max()) or 1.0
                out = []
                for i in range(0, len(q), 256):
                    part = q[i : i + 256]
                    at, _ = beam_search(x, graph, row["start"], placed(part, middle, scale, most), beam)
                    for own, name, one, found in zip(qrow[i : i + 256].tolist(), qid[i : i + 256].tolist(), part, at):
                        found = found[found >= 0]
                        away = v[found] - one
                        unit = np.abs(away).max(axis=1)  # squares of the largest doubles would overflow
                        d = unit * np.sqrt(((away / np.where(unit > 0, unit, 1)[:, None]) ** 2).sum(axis=1)) if unit.size and not 1e-140 < unit.max() < 1e140 else np.sqrt((away**2).sum(axis=1))
                        near = []
                        for j in np.argsort(d, kind="stable").tolist():
                            if len(near) >= k and d[j] > near[-1][0]:
                                break
                            here = slice(first[found[j]], first[found[j] + 1])
                            others = ids[here][rows[here] != own][:k].tolist()
                            near = sorted(near + [(d[j], c) for c in others])[:k]
                        out += [(own, name, c, s) for s, c in near]
                cols = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_row", "query_id", "vec_id", "score"])

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(shards, 1) - 1).cast("long")))
    tasks = max(shards, 1)  # not left to be merged by bytes: a shard's cost is its searches
    pairs = packed.withColumn("shard", every).repartition(tasks, "shard").join(index.repartition(tasks, "shard").hint("merge"), "shard")
    found = pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def op2_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search_index(build_index(rows), rows.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")
