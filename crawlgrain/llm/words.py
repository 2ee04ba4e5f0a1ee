"""Vectorised word splitting and hashing over UTF-8 buffers (numpy, no Python loop per word).

A batch of texts is one byte buffer; words are runs of bytes outside a separator
table. Hashes are polynomial over the bytes (or over word hashes, for windows), so
every sub-range costs one subtraction on a prefix sum, and are then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_CHUNK = 1 << 18

#: Separators of the words `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Separators that leave ASCII letters and digits and every non-ASCII character.
PUNCT = np.ones(256, dtype=bool)
PUNCT[128:] = False
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a uint64 array."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Poly:
    """Polynomial hashing modulo 2**64 with an odd random base, by seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda n: rng.integers(0, 2**64, n, dtype=U64)
        self.table = draw(256)
        self.base = int(draw(1)[0]) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self._pow = self._inv = np.ones(1, dtype=U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            size = -(-n // _CHUNK) * _CHUNK
            for name, b in (("_pow", self.base), ("_inv", self.inverse)):
                steps = np.full(size, b, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self._pow[:n], self._inv[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums, with a leading zero."""
        out = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self.powers(len(values))[0], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = prefix[ends] - prefix[starts]
        h *= self.powers(len(prefix))[1][starts]
        return mix(h)


_POLY: dict[int, Poly] = {}


def poly(seed: int) -> Poly:
    return _POLY.setdefault(seed, Poly(seed))


@dataclass
class Words:
    """Words of a batch of texts: byte bounds in `buf` and the index of their text."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self, seed: int = 1, prefix_bytes: tuple[int, ...] = ()) -> list[np.ndarray]:
        """A uint64 hash for each word; then, for each length, of its first bytes (0: word not longer)."""
        p, n = poly(seed), len(self.starts)
        out = [np.zeros(n, dtype=U64) for _ in range(1 + len(prefix_bytes))]
        at = 0
        while at < n:
            lo = int(self.starts[at])
            to = max(int(np.searchsorted(self.ends, lo + _CHUNK, "right")), at + 1)
            s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
            sums = p.prefix(p.table[self.buf[lo : int(self.ends[to - 1])]])
            out[0][at:to] = p.ranges(sums, s, e)
            for k, size in enumerate(prefix_bytes, 1):
                longer = e - s > size
                out[k][at:to][longer] = p.ranges(sums, s[longer], s[longer] + size) ^ U64(size)
            at = to
        return out


def split(texts: pa.Array, separators: np.ndarray = WHITE) -> Words:
    """Words of every text; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(raw)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), empty, empty, empty, 0)
    buf = np.frombuffer(b"\n".join(raw.to_pylist()), dtype=np.uint8)
    begins = np.zeros(n, dtype=np.int64)
    np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False)[:-1] + 1, out=begins[1:])
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[buf]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Words(buf, starts, ends, np.searchsorted(begins, starts, "right") - 1, n)


def portions(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of texts of about `limit` bytes at most; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")) - at)
        yield at, n
        at += n


def windows(hashes: np.ndarray, doc: np.ndarray, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all windows of `size` words inside one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    p = poly(seed)
    return at, p.ranges(p.prefix(hashes), at, at + size)


def cover(n: int, starts: np.ndarray, sizes: int | np.ndarray) -> np.ndarray:
    """Mask of the n positions that some range [start, start + size) covers."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(delta[:n]) > 0
