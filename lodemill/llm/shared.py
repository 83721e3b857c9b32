"""What the operators of this subpackage share: shipping, checkpoints, Arrow text blocks, hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled by one round of numpy calls; a longer single text makes a block of its own.
BLOCK = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one is set here if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------------------- text


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(off, kind, n + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:
        live = np.asarray(col.is_valid())
        size = np.where(live, np.diff(at), 0)
        if int(size.sum()) != int(at[-1] - at[0]):  # bytes behind a null: copy the others together
            keep = [raw[a : a + k] for a, k in zip(at[:-1], size)]
            raw = np.concatenate(keep) if keep else raw[:0]
            return raw, np.concatenate(([0], np.cumsum(size)))
    return raw[at[0] : at[-1]], at - at[0]


def blocks(off: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or one row)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


# ------------------------------------------------------------------------------------------- hashing

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_KEY, _LEN = U(0x243F6A8885A308D3), U(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_power: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n+1 powers of the base and of its inverse, modulo 2**64."""
    if len(_power.get("up", ())) <= n:
        size = max(n + 1, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _power[name] = np.cumprod(out, dtype=np.uint64)
    return _power["up"], _power["down"]


def lanes(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of ``b`` on as one number each; zeros stand behind its end."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    return np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))


#: lengths of 0 to 8 bytes as masks of a lane
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each b[lo:hi]; equal bytes give equal hashes anywhere.

    Lanes of 8 bytes are mixed with their place in the span, each by itself, and then added, so no
    pattern of the bytes cancels out: different spans meet as random numbers of 64 bits would.
    """
    lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
    size, all_lanes = hi - lo, lanes(b)
    out = mix(all_lanes[lo] & _MASK[np.minimum(size, 8)] ^ _KEY) + size.astype(np.uint64) * _LEN
    more = np.flatnonzero(size > 8)
    if len(more):
        n = (size[more] - 1) // 8  # further lanes
        k = ragged(n, np.ones(len(n), np.int64), n)
        at = np.repeat(lo[more], n) + 8 * k
        left = np.minimum(np.repeat(hi[more], n) - at, 8)
        part = mix(all_lanes[at] & _MASK[left] ^ mix(_KEY + k.astype(np.uint64)))
        out[more] += np.add.reduceat(part, np.cumsum(n) - n)
    return mix(out)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and where each element stands among them."""
    n = len(h)
    low = U((1 << n.bit_length()) - 1)
    order = (np.sort((h & ~low) | np.arange(n, dtype=np.uint64)) & low).view(np.int64)  # places as the lowest bits
    s = h.take(order)
    if (s[1:] < s[:-1]).any():  # values that differ in these bits alone
        order = np.argsort(h)
        s = h.take(order)
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], order[new], which


def same_heads(b: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the first 8 bytes (or size[i], if fewer) from one[i] and other[i] on are the same."""
    lane, mask = lanes(b), _MASK.take(np.minimum(size, 8))
    return ((lane.take(one) ^ lane.take(other)) & mask) == 0


def equal_spans(b: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether b[one[i]:one[i]+size[i]] and b[other[i]:other[i]+size[i]] hold the same bytes, for each i."""
    out = np.ones(len(size), bool)
    live = np.flatnonzero((size > 0) & (one != other))
    for i in range(0, len(live), 1 << 14):
        at = live[i : i + (1 << 14)]
        same = b[ragged(b, one[at], size[at])] == b[ragged(b, other[at], size[at])]
        out[at] = np.logical_and.reduceat(same, np.cumsum(size[at]) - size[at])
    return out


def word_spans(b: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of texts, and the first word of each text.

    A word is a run of bytes other than those in ``white`` (0x20 and 0x09-0x0D); it never crosses texts.
    """
    n = len(b)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    inside = ~white[b]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def gram_hashes(g: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k word hashes (len(g) - k + 1 of them, none if g is shorter)."""
    m = len(g) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, U(k * 0xA24BAED4963EE407 % (1 << 64)), np.uint64)
    for j in range(k):
        out += g[j : j + m] * U(pow(_BASE, 2 * j + 3, 1 << 64))
    return mix(out)


def ragged(flat: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices lo[i], lo[i]+1, ..., lo[i]+size[i]-1 for all i, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    return np.repeat(lo - first, size) + np.arange(total)
