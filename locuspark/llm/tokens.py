"""Token hashes of whole Arrow slices at once, with numpy.

A token is a run of word bytes (ASCII letters, digits, ``_`` and every byte
from 0x80 on) or, if asked for, a run of other bytes that are not white space.
Tokens never cross documents. The hash of a byte run is a polynomial modulo
2**64, taken from prefix sums, so that its cost does not depend on the number
of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
ROOT = 0x9E3779B97F4A7C15 | 1
SPACE, WORD, MARK = 0, 1, 2


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each byte."""
    kind = np.full(256, MARK, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = WORD
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


def powers(n: int, root: int = ROOT, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  tables of a worker
    up, down = cache.get(root, ((), ()))
    if len(up) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        with np.errstate(over="ignore"):
            for base in (root, pow(root, -1, 1 << 64)):
                out = np.ones(size, U)
                done = 1
                while done < size:
                    step = U(pow(base, done, 1 << 64))
                    out[done : 2 * done] = out[: min(done, size - done)] * step
                    done *= 2
                both.append(out)
        up, down = cache[root] = tuple(both)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: neighbouring inputs end up far apart."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(31))
        h = h * U(0x7FB5D329728EA185)
        h = h ^ (h >> U(27))
        h = h * U(0x81DADEF4BC2DD44D)
        return h ^ (h >> U(33))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Runs:
    """Tokens of a slice: ``start``, ``end`` (bytes), ``doc``, ``mark`` and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: bool = False, lower: bool = True):
        kinds, low = tables()
        self.data, self.offsets = data, offsets
        n = len(data)
        kind = kinds[data]
        if not marks:
            kind = kind * (kind == WORD)
        new = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:n])
        new[offsets] = True
        edge = np.flatnonzero(new)
        if n == 0:
            edge = np.zeros(1, np.int64)
        start, end = edge[:-1], edge[1:]
        keep = kind[start] != SPACE if len(start) else np.zeros(0, bool)
        self.start, self.end = start[keep], end[keep]
        self.mark = kind[self.start] == MARK
        self.folded = low[data] if lower else data
        up, self._down = powers(n + 1)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(n + 1, U)
            np.cumsum((self.folded.astype(U) + U(1)) * up[:n], out=self._sums[1:])
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges."""
        with np.errstate(over="ignore"):
            return mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def words(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def bounds(self, n_docs: int) -> np.ndarray:
        """First token of each document, and the number of tokens at the end."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def combine(hashes: list[np.ndarray], salt: int) -> np.ndarray:
    """One hash of several aligned ones, in order."""
    with np.errstate(over="ignore"):
        out = np.full(len(hashes[0]), salt * 0x632BE59BD9B4E019 & (1 << 64) - 1, U)
        for h in hashes:
            out = (out ^ h) * U(0xD6E8FEB86659FD93)
            out ^= out >> U(32)
    return out


def ngrams(h: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that stay in one document, and their documents."""
    if len(h) < n:
        return h[:0], doc[:0]
    m = len(h) - n + 1
    keep = doc[:m] == doc[n - 1 :]
    return combine([h[i : i + m] for i in range(n)], salt)[keep], doc[:m][keep]
