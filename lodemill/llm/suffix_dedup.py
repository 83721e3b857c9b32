"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
doc_id. Texts never travel whole to find such strings:

1. Every string of LENGTH bytes owns an anchor, the GRAM bytes in it with the least hash, so equal
   strings have equal anchors. Each batch of documents sends its sorted anchor hashes, split over hash
   ranges; the sorted runs of all batches are merged by binary search, which finds the anchors that
   more than one document has.
2. The passages around those anchors go to shards by anchor, copies within a batch once. A shard sorts
   all their suffixes by Larsson-Sadakane refinement (ranks of 4 bytes, doubled until all differ),
   takes common prefixes by Kasai's rule on the text order, and cuts the suffix array into runs with a
   common prefix of LENGTH. The smallest doc_id of a run owns the string; the others lose it.
3. The lost strings of a document are united, and their bytes leave its text.

Bounds: ranges and shards grow with the bytes of text, TASK for each. An anchor in over HOT documents of a batch is sent once for them, and its strings are then
dealt one by one by their own hash, so what any task gathers for one string is a row from each batch.
Anchors are mixed anew before they are dealt: as least hashes
of a window they are small numbers, of which the first range would get far more than its share. An anchor
with over ARRAY bytes of different passages in a shard has its strings compared one by one, too.
Of equal passages in a batch or shard only the smallest document's is compared: the others lose it in
any case; and a shard leaves out the passages that alone have their anchor.

Defined results: a null text is empty; rows that share a doc_id do not repeat one another; a null
doc_id takes no part and its text stays whole; repeated rows lose alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import U, _BYTE, _powers, blocks, equal_spans, mix, partitions, ragged, ship, span_hashes, utf8

LENGTH, GRAM = 50, 20
HOT = 256
#: Text bytes hashed together, and passage bytes of one suffix array.
SLICE, ARRAY = 1 << 18, 1 << 20
#: Text bytes among which a task drops copies before it sends.
BATCH = 16 << 20
#: Passage bytes after which a batch is sent in parts; only strings dealt one by one come to so many.
PASSAGES = 64 << 20
#: The least hash of a window is a small number, and half of all would be in the first of 50 ranges: mixed anew.
_EVEN = U(0x2545F4914F6CDD1D)
#: Text bytes for which there is one hash range, one shard, and one task for either.
TASK = 16 << 20


def tasks_for(texts: DataFrame, text: str = "text") -> int:
    """How many ranges and shards the texts are dealt to: by their bytes, so that a task's share stays."""
    total = texts.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-int(total) // TASK))


# ------------------------------------------------------------------------------------------ anchors


def anchors(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first, last) of each anchor: it owns the strings that start at first..last of the block."""
    n = len(b)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * up[:n], dtype=np.uint64, out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    bits = U((1 << 20) - 1 if n <= 1 << 20 else (1 << int(n).bit_length()) - 1)
    low = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    least = low
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    own = (least & bits).astype(np.int64)  # of each string of LENGTH bytes, the place of its anchor
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(n) + LENGTH <= off[1:][text])
    own = own[at]
    new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(at) else none
    first = at[new]
    last = at[np.concatenate((new[1:], [len(at)])) - 1] if len(at) else none
    return mix(h[own[new]] ^ _EVEN), text[first], first, last


def _pressed(raw: bytes) -> bytes:
    """``raw`` for the shuffle: its length, and the bytes compressed."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpressed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    """Sorted or small 64-bit values with equal bytes side by side, compressed."""
    raw, out = a.astype("<u8").view(np.uint8), np.empty((8, len(a)), np.uint8)
    for k in range(8):
        out[k] = raw[k::8]
    return _pressed(out.tobytes())


def _unplaned(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpressed(raw), np.uint8).reshape(8, -1)
    out = np.empty((planes.shape[1], 8), np.uint8)
    for k in range(8):
        out[:, k] = planes[k]
    return out.view("<u8").ravel()


def pieces_of(batch: pa.RecordBatch, column: int):
    """Slices of a batch with at most BATCH bytes of text (or one row)."""
    _, off = utf8(batch.column(column))
    for i, j in blocks(off, BATCH):
        yield batch.slice(i, j - i)


def _batch_anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, doc_id) of a batch (doc_id, text), by hash."""
    doc = batch.column(0).to_numpy(zero_copy_only=False)
    b, off = utf8(batch.column(1))
    hs, ds = [], []
    for i, j in blocks(off, SLICE):
        h, text, _, _ = anchors(b[off[i] : off[j]], off[i : j + 1] - off[i])
        hs.append(h)
        ds.append(doc[i + text])
    h, d = (np.concatenate(hs), np.concatenate(ds)) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order].astype(np.int64)
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    if len(same):  # within runs of a hash, documents in order and once
        run = np.cumsum(np.concatenate(([True], h[1:] != h[:-1])))
        inner = np.zeros(len(h), bool)
        inner[same], inner[same - 1] = True, True
        at = np.flatnonzero(inner)
        order = at[np.lexsort((d[at], run[at]))]
        h[at], d[at] = h[order], d[order]
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        h, d = h[keep], d[keep]
    return h, d


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate((first, [len(h)])))


def shared_anchors(docs: DataFrame, ranges: int, hot: int = HOT) -> DataFrame:
    """(doc_id, h, hot) of the anchors that more than one document has, merged in ``ranges`` ranges."""
    names = ["r", "h", "doc", "hot"]

    def send(batches):
        for k, batch in enumerate(p for whole in batches for p in pieces_of(whole, 1)):
            h, d = _batch_anchors(batch)
            first, count = _runs(h)
            loud = np.repeat(count > hot, count)
            rows = []
            if loud.any():  # a place of their own: they are known to be shared
                place = ranges + int(mix(np.array([d[0]], np.uint64) + U(k))[0] % U(ranges))
                rows.append((place, h[loud], d[loud], b""))
            keep = ~loud
            keep[first] = True
            h, d, loud = h[keep], d[keep], loud[keep]
            cut = np.searchsorted(h, np.array([*((1 << 64) * r // ranges for r in range(ranges)), (1 << 64) - 1], np.uint64), "left").tolist()
            cut[-1] = len(h)
            rows += [(r, h[a:z], d[a:z], np.packbits(loud[a:z]).tobytes()) for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([_planes(np.diff(r[1], prepend=U(0))) for r in rows], pa.binary()), pa.array([_planes(r[2]) for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    def merge(table: pa.Table) -> pa.Table:
        runs = [np.cumsum(_unplaned(x.as_py()), dtype=np.uint64) for x in table.column("h")]
        docs_ = [_unplaned(x.as_py()).view(np.int64) for x in table.column("doc")]
        if table.column("r")[0].as_py() >= ranges:
            h, d = np.concatenate(runs), np.concatenate(docs_)
            return pa.table({"doc_id": d, "h": h.view(np.int64), "hot": np.ones(len(h), bool)})
        flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("hot"), runs)]
        everyone = np.sort(np.concatenate(runs))
        loud = np.unique(np.concatenate([h[f] for h, f in zip(runs, flags)]))
        out = []
        for h, d, f in zip(runs, docs_, flags):
            times = np.searchsorted(everyone, h, "right") - np.searchsorted(everyone, h, "left")
            at = np.minimum(np.searchsorted(loud, h), max(len(loud) - 1, 0))
            is_hot = loud[at] == h if len(loud) else np.zeros(len(h), bool)
            keep = ((times > 1) | is_hot) & ~f  # the flagged ones go by their own place
            out.append((d[keep], h[keep], is_hot[keep]))
        d, h, f = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": d, "h": h.view(np.int64), "hot": f})

    sent = docs.select("doc_id", "text").mapInArrow(send, "r long, h binary, doc binary, hot binary")
    return sent.repartition(ranges, "r").groupBy("r").applyInArrow(merge, "doc_id long, h long, hot boolean")


# ------------------------------------------------------------------------------------ suffix arrays


def suffix_array(t: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes t[i:end[i]], equal ones by place, by Larsson-Sadakane refinement."""
    n = len(t)
    pad = np.concatenate((t.astype(np.uint64) + U(1), np.zeros(4, np.uint64)))
    here = np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key = (key << U(9)) | np.where(here + j < end, pad[j : n + j], U(0))
    low = U((1 << 27) - 1)
    if n > 1 << 27:
        raise ValueError("a suffix array holds at most 2**27 bytes")
    packed = np.sort((key << U(27)) | here.astype(np.uint64))
    sa = (packed & low).astype(np.int64)
    new = np.concatenate(([True], (packed[1:] ^ packed[:-1]) > low))
    first = np.maximum.accumulate(np.where(new, here, 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = first + 1, 0  # 0 ranks what lies beyond an end
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    open_ = np.flatnonzero(size[group] > 1)  # places in sa that are not yet sorted, and their groups
    at_group, h = group[open_], 4
    longest = int((end - here).max()) if n else 0
    while len(open_) and h < longest:
        s = sa[open_]
        nxt = np.where(s + h < end[s], rank[np.minimum(s + h, n)], 0)
        dense = np.cumsum(np.concatenate(([False], at_group[1:] != at_group[:-1])))
        m = len(open_)
        bm, bn = max(1, int(m).bit_length()), max(1, int(n + 1).bit_length())
        if 2 * bm + bn <= 64:
            p = np.sort((dense.astype(np.uint64) << U(bm + bn)) | (nxt.astype(np.uint64) << U(bm)) | np.arange(m, dtype=np.uint64))
            order = (p & U((1 << bm) - 1)).astype(np.int64)
            head = np.concatenate(([True], (p[1:] >> U(bm)) != (p[:-1] >> U(bm))))
        else:
            order = np.lexsort((nxt, dense))
            a, b = dense[order], nxt[order]
            head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        s = s[order]
        sa[open_] = s
        rank[s] = open_[np.maximum.accumulate(np.where(head, np.arange(m), 0))] + 1
        sub = np.cumsum(head) - 1
        more = np.bincount(sub)[sub] > 1
        open_, at_group, h = open_[more], sub[more], 2 * h
    return sa


def common_prefixes(t: np.ndarray, end: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``sa``, the common prefix with the suffix before it.

    Kasai's rule, in text order: where a suffix and its predecessor in the array follow equal bytes,
    its value is one less than that of the suffix one byte earlier; only the others are compared.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    start = np.concatenate(([True], end[1:] != end[:-1]))  # first bytes of passages
    j = before
    follows = (j > 0) & ~start & ~start[np.maximum(j, 0)]
    follows &= t[here - 1] == t[np.maximum(j, 1) - 1]
    value = np.zeros(n, np.int64)
    todo = np.flatnonzero(~follows & (j >= 0))
    a, b, k = todo, j[todo], 0
    while len(a):
        same = (a + k < end[a]) & (b + k < end[b])
        a, b = a[same], b[same]
        same = t[a + k] == t[b + k]
        a, b = a[same], b[same]
        k += 1
        value[a] = k
    base = np.maximum.accumulate(np.where(follows, 0, here))
    return np.maximum(value[base] - (here - base), 0)[sa]


def lost_strings(t: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes from each place also start at a place of a smaller doc."""
    sa = suffix_array(t, end)
    new = common_prefixes(t, end, sa) < LENGTH
    new[:1] = True
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(doc[sa], first) if len(first) else doc[:0]
    out = np.zeros(len(t), bool)
    run = np.cumsum(new) - 1
    out[sa] = (low[run] < doc[sa]) & (end[sa] - sa >= LENGTH)
    return out


# ---------------------------------------------------------------------------------------- passages


def _passages(batch: pa.RecordBatch):
    """(key, doc_id, start in the text, hash, bytes, offsets) of the passages of a batch (doc_id, text, cold, hot), in parts."""
    doc = batch.column(0).to_numpy(zero_copy_only=False)
    b, off = utf8(batch.column(1))
    want = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(c.values) else np.zeros(0, np.uint64), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
    held, n = [], 0
    for i, j in blocks(off, SLICE):
        base = off[i]
        part = b[base : off[j]]
        h, text, first, last = anchors(part, off[i : j + 1] - base)
        is_in = []
        for flat, at in want:
            own = flat[at[i] : at[j]]
            row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(at[i : j + 1]))
            asked = np.unique(mix(own + row * U(0xD1342543DE82EF95)))
            mine = mix(h + text.astype(np.uint64) * U(0xD1342543DE82EF95))
            k = np.minimum(np.searchsorted(asked, mine), max(len(asked) - 1, 0))
            is_in.append(asked[k] == mine if len(asked) else np.zeros(len(h), bool))
        cold, hot = is_in[0] & ~is_in[1], is_in[1]
        lo, hi, key, t = first[cold], last[cold] + LENGTH, h[cold], text[cold]
        raw = part[ragged(part, lo, hi - lo)]
        if hot.any():  # their strings one by one, by their own hash
            own = ragged(part, first[hot], last[hot] - first[hot] + 1)
            lo, hi = np.concatenate((lo, own)), np.concatenate((hi, own + LENGTH))
            key = np.concatenate((key, span_hashes(part, own, own + LENGTH)))
            t = np.concatenate((t, np.repeat(text[hot], last[hot] - first[hot] + 1)))
            raw = np.concatenate((raw, np.lib.stride_tricks.sliding_window_view(part, LENGTH)[own].ravel()))
        held.append((key, doc[i + t].astype(np.int64), lo + base - off[i + t], mix(span_hashes(part, lo, hi) + key), raw, hi - lo))
        n += len(raw)
        if n >= PASSAGES:
            yield _joined(held)
            held, n = [], 0
    if n:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, ...]:
    *cols, size = (np.concatenate(x) for x in zip(*held))
    return *cols, np.concatenate(([0], np.cumsum(size)))


def _by_block(run, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """run(lo, size) of spans, a block of their bytes at a time."""
    return np.concatenate([run(lo[i:j], size[i:j]) for i, j in blocks(np.concatenate(([0], np.cumsum(size))))])


def _lost(key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, off: np.ndarray, raw: np.ndarray):
    """(doc, lo, hi) of what passages in the order of their keys lose: whole keys, up to ARRAY bytes at a time.

    Where one key has more bytes, its strings are told apart by their own hashes, as those of a hot anchor are.
    """
    bytes_to = np.cumsum(size)
    first, count = _runs(key)
    a, edges = 0, (first + count).tolist()
    for e, z in enumerate(edges):
        if e + 1 < len(edges) and bytes_to[edges[e + 1] - 1] - (bytes_to[a - 1] if a else 0) <= ARRAY:
            continue
        n, d, at = size[a:z], doc[a:z], start[a:z]
        t = _by_block(lambda lo, k: raw[ragged(raw, lo, k)], off[a:z], n)
        end_of = np.cumsum(n)
        same = mix(_by_block(lambda lo, k: span_hashes(t, lo, lo + k), end_of - n, n) + key[a:z])
        order = np.lexsort((d, same))
        new = np.concatenate(([True], same[order][1:] != same[order][:-1]))
        low = np.empty(z - a, np.int64)
        low[order] = order[np.maximum.accumulate(np.where(new, np.arange(z - a), 0))]
        gone = (d > d[low]) & (n == n[low])
        gone[gone] = equal_spans(t, (end_of - n)[gone], (end_of - n)[low[gone]], n[gone])  # copies of a passage of a smaller document
        yield d[gone], at[gone], at[gone] + n[gone]
        kinds = key[a:z][order[new]]  # of an anchor with one passage nothing else can be lost
        kinds, times = np.unique(kinds, return_counts=True)
        left = np.flatnonzero(~gone & (times[np.searchsorted(kinds, key[a:z])] > 1))
        a = z
        if not len(left):
            continue
        t = _by_block(lambda lo, k: t[ragged(t, lo, k)], (end_of - n)[left], n[left])
        n, d, at = n[left], d[left], at[left]
        end_of = np.cumsum(n)
        if len(t) > ARRAY and int(n.max()) > LENGTH:
            k = n - LENGTH + 1
            own = ragged(t, end_of - n, k)
            row = np.repeat(np.arange(len(n)), k)
            string = _by_block(lambda lo, size: span_hashes(t, lo, lo + size), own, np.full(len(own), LENGTH))
            order = np.argsort(string, kind="stable")
            own, row = own[order], row[order]
            yield from _lost(string[order], d[row], at[row] + own - (end_of - n)[row], np.full(len(own), LENGTH), own, t)
            continue
        lost = lost_strings(t, np.repeat(end_of, n), np.repeat(d, n))
        row = np.repeat(np.arange(len(left)), n)
        hit = np.flatnonzero(lost)
        if len(hit):
            new = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1]))))
            last = hit[np.concatenate((new[1:], [len(hit)])) - 1]
            r = row[hit[new]]
            shift = at[r] - (end_of - n)[r]
            yield d[r], hit[new] + shift, last + shift + LENGTH


def lost_spans(docs: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """(doc_id, lo, hi): byte spans that leave a document, found in ``shards`` shards; they may overlap."""
    names = ["r", "key", "doc", "start", "size", "bytes"]

    def send(batches):
        for k, got in enumerate(x for whole in batches for p in pieces_of(whole, 1) for x in _passages(p)):
            key, doc, start, same, raw, off = got
            size = np.diff(off)
            order = np.lexsort((start, doc, same))
            first = np.concatenate(([True], same[order][1:] != same[order][:-1]))
            low = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            copy = (doc[order] > doc[low]) & (size[order] == size[low])
            copy[copy] = equal_spans(raw, off[order[copy]], off[low[copy]], size[order[copy]])
            gone, kept = order[copy], order[~copy]  # gone: copies, byte for byte, of a passage of a smaller document of this batch
            kept = kept[np.argsort(key[kept], kind="stable")]
            rows = []
            if len(gone):
                g = gone[np.lexsort((start[gone], doc[gone]))]
                d, lo, hi = doc[g], start[g], start[g] + size[g]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (lo[1:] > hi[:-1]))))
                hi = np.maximum.reduceat(hi, new)  # passages of a document: later starts end later
                place = shards + int(mix(np.array([doc[0]], np.uint64) + U(k))[0] % U(shards))
                rows.append((place, key[:0], d[new], lo[new], hi - lo[new], b""))
            shard = (key[kept] // U((1 << 64) // shards + 1)).astype(np.int64)
            cut = np.searchsorted(shard, np.arange(shards + 1)).tolist()
            for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])):
                if z > a:
                    s = kept[a:z]
                    rows.append((r, key[s], doc[s], start[s], size[s], _pressed(raw[ragged(raw, off[s], size[s])].tobytes())))
            cols = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([_planes(r[c]) for r in rows], pa.binary()) for c in range(1, 5)), pa.array([r[5] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    def judge(table: pa.Table) -> pa.Table:
        def whole(name):
            return np.concatenate([_unplaned(x.as_py()) for x in table.column(name)])

        doc, start, size = whole("doc").view(np.int64), whole("start").view(np.int64), whole("size").view(np.int64)
        if table.column("r")[0].as_py() >= shards:
            return pa.table({"doc_id": doc, "lo": start, "hi": start + size})
        key = whole("key")
        raw = np.concatenate([np.frombuffer(_unpressed(x.as_py()), np.uint8) for x in table.column("bytes")])
        off = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        out = list(_lost(key[order], doc[order], start[order], size[order], off[order], raw))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("doc_id", "lo", "hi"), cols)))

    asked = shared.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    sent = docs.select("doc_id", "text").join(asked, "doc_id").select("doc_id", "text", "cold", "hot")
    return sent.mapInArrow(send, "r long, key binary, doc binary, start binary, size binary, bytes binary").repartition(shards, "r").groupBy("r").applyInArrow(judge, "doc_id long, lo long, hi long")


def union_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > top[:-1]))
    return lo[new], top[np.concatenate((np.flatnonzero(new)[1:], [len(lo)])) - 1]


def with_spans(docs: DataFrame, keep: list[str] | None = None, hot: int = HOT, out: str = "removed") -> DataFrame:
    """The rows of ``docs`` with ``out``, the maximal byte spans [lo, hi) that leave their text."""
    spark = docs.sparkSession
    ship(spark)
    keep = docs.columns if keep is None else keep
    rest = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    own = rest.where("doc_id is not null")  # dealt by doc_id once, for both joins, if no other column is kept
    texts = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = tasks_for(texts)
    spans = lost_spans(texts, shared_anchors(texts, tasks, hot), tasks).groupBy(F.col("doc_id").alias("_span_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    names = [F.col(c) for c in dict.fromkeys([*keep, "text"])]
    done = own.join(spans, F.col("doc_id") == F.col("_span_doc"), "left").select(*names, F.col("_spans").alias(out))
    return done.unionByName(rest.where("doc_id is null").select(*names, F.lit(None).cast(done.schema[out].dataType).alias(out)))


def _kept(raw: bytes, spans) -> tuple[bytes, int, int]:
    if not spans:
        return raw, 0, 0
    lo, hi = union_spans(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
    edge = [0, *np.column_stack((lo, hi)).ravel().tolist(), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edge[::2], edge[1::2])), int((hi - lo).sum()), len(lo)


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated strings out of ``text``, and n_chars (if it is a column) anew.

    A character that loses some of its bytes goes whole.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    others = [c for c in names if c != "text"]

    def run(batches):
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist()):
                texts.append(t if t is None or not spans else _kept(t.encode(), spans)[0].decode("utf-8", "ignore"))
            cols = dict(zip(others, batch.columns)) | {"text": pa.array(texts, pa.string())}
            if kinds.get("n_chars") == "bigint":
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    out = "removed"
    while out in names:
        out = f"_{out}"
    return with_spans(docs, others, hot, out).select(*others, "text", out).mapInArrow(run, docs.schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for d, t, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (t or "").encode()
                kept, gone, n = _kept(raw, spans)
                rows.append((d, len(raw), gone, n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 5
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)

    out = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "text", "removed").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
