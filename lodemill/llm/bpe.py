"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece encoded once.

Where no two white-space characters stand side by side, the byte-level pattern ends a pre-token
before every space (which goes with what follows) and on both sides of every line feed. Such texts
are cut there; a call's equal pieces are met by hash and compared byte for byte, and the ids of each
are looked up, or encoded by the library when first seen: pieces without white space but a space in front
many at once, with line feeds between, which the pattern parts from them. All other texts are encoded by
the library as they are. Both ways give the ids of ``encode`` on the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .shared import blocks, distinct, equal_spans, same_heads, span_hashes, utf8

_AWKWARD = re.compile(r"\s\s")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_FEED, _SPACE = 0x0A, 0x20
#: Text bytes met together; a longer single text is met alone.
PART = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts; keeps the ids of about ``most`` distinct pieces, or 2**26 ids, then starts anew.

    Texts of ``long`` bytes or more are encoded by the library as they are.
    """

    def __init__(self, path: str, most: int = 1_200_000, long: int = 1 << 22):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most, self.long = most, long
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.lo, self.size, self.n = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32), 0

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.flat.dtype, int(sizes.sum())), sizes

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that hold no white space but a space in front."""
        if self.feed is not None:
            ids, _ = self._ids(["\n".join(pieces[k : k + 64]) + "\n" for k in range(0, len(pieces), 64)])
            at = np.flatnonzero(ids == self.feed)
            if len(at) == len(pieces):
                return ids[ids != self.feed], np.diff(at, prepend=-1) - 1
        return self._ids(pieces)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Places of new pieces."""
        texts = [p.decode() for p in pieces]
        bare = [t[1:] if t[0] == " " else t for t in texts]
        easy = np.fromiter((t.split() == [t] for t in bare), bool, len(texts))
        out = np.empty(len(pieces), np.int64)
        for which, ids_of in ((np.flatnonzero(easy), self._joined), (np.flatnonzero(~easy), self._ids)):
            for k in range(0, len(which), 8192):
                part = which[k : k + 8192]
                ids, sizes = ids_of([texts[i] for i in part.tolist()])
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
                while self.n + len(part) > len(self.lo):
                    self.lo, self.size = np.concatenate((self.lo, self.lo)), np.concatenate((self.size, self.size))
                self.flat[self.used : self.used + len(ids)] = ids
                self.lo[self.n : self.n + len(part)] = self.used + np.cumsum(sizes) - sizes
                self.size[self.n : self.n + len(part)] = sizes
                out[part] = np.arange(self.n, self.n + len(part))
                self.used += len(ids)
                self.n += len(part)
        self.place.update(zip(pieces, out.tolist()))
        return out

    def _plain(self, texts: list[str | None], b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each text is shorter than ``long`` bytes and without adjacent white space."""
        if len(texts) == 1 and len(b) >= self.long:
            return np.zeros(1, bool)
        blank = _BLANK[b]
        pairs = np.concatenate(([0], np.cumsum(blank[1:] & blank[:-1]), [0]))
        high = np.concatenate(([0], np.cumsum(b >= 0x80)))
        size = np.diff(off)
        out = (size > 0) & (size < self.long)
        out &= pairs[np.maximum(off[1:] - 1, 0)] == pairs[off[:-1]]
        for i in np.flatnonzero(out & (high[off[1:]] > high[off[:-1]])).tolist():
            out[i] = not _AWKWARD.search(texts[i])
        return out

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets); ``end`` is appended to each text."""
        b, off = utf8(pa.array(texts, pa.large_string()))
        tail = np.array([] if end is None else [end], np.uint32)
        parts = [self._encode(texts[i:j], b[off[i] : off[j]], off[i : j + 1] - off[i], tail) for i, j in blocks(off, PART)]
        ids, sizes = zip(*parts) if parts else ((tail[:0],), ([],))
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(list(chain.from_iterable(sizes)), dtype=np.int64)))

    def _encode(self, texts: list[str | None], b: np.ndarray, off: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, list[int]]:
        if self.n > self.most or self.used > 1 << 26:  # few pieces may hold many ids
            self._clear()
        plain = self._plain(texts, b, off)
        size = np.diff(off)[plain]
        b = b if plain.all() else np.concatenate([b[:0], *(b[off[i] : off[i + 1]] for i in np.flatnonzero(plain).tolist())])
        start = np.zeros(len(b) + 1, bool)
        own = np.cumsum(size) - size
        start[own] = True
        feed = b == _FEED
        start[:-1] |= feed | (b == _SPACE)
        start[1:] |= feed
        lo = np.flatnonzero(start[:-1])
        size = np.diff(lo, append=len(b))
        _, first, which = distinct(span_hashes(b, lo, lo + size))
        twin = first.take(which)
        if not (same_heads(b, lo, lo[twin], size) & (size == size[twin])).all() or not equal_spans(b, lo[long_ := np.flatnonzero(size > 8)], lo[twin[long_]], size[long_]).all():
            plain[:], first, which, lo = False, first[:0], which[:0], lo[:0]  # hashes met: the library encodes all
        plain, raw = plain.tolist(), b.tobytes()
        count = np.diff(np.searchsorted(lo, own), append=len(lo)) if len(lo) else own[:0]
        other = [t for t, p in zip(texts, plain) if t and not p]
        other = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False)) if other else iter(())
        pieces = [raw[a:z] for a, z in zip(lo[first].tolist(), (lo[first] + size[first]).tolist())]
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn([pieces[i] for i in new.tolist()])
        at = at[which]
        n = self.size[at]
        last = np.cumsum(n, dtype=np.int64)
        total = int(last[-1]) if len(last) else 0
        shift = self.lo[at] - (last - n).astype(np.int32)
        ids = self.flat[np.repeat(shift, n) + np.arange(total, dtype=np.int32)]
        stop = np.concatenate(([0], last))[np.cumsum([0, *count])].tolist()
        out, size, k = [], [], 0
        for t, p in zip(texts, plain):
            if p:
                own = ids[stop[k] : stop[k + 1]]
                k += 1
            else:
                own = np.array(next(other).ids, np.uint32) if t else tail[:0]
            out += [own, tail]
            size.append(len(own) + len(tail))
        return np.concatenate(out).astype(np.uint32), size


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
