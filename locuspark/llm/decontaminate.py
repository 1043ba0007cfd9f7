"""Benchmark decontamination with spaced seeds.

A test item contaminates a document where an ungapped alignment of the two has
``WINDOW`` tokens (the whole item, if shorter) of which at least ``SHARE``
agree. Spaced seeds are fixed masks that ignore some positions; their hashes
join documents with test items. The three masks of weight six are lossless:
every way to substitute 4 of 20 tokens leaves one of them intact somewhere.
Shorter items use contiguous seeds whose length the pigeonhole principle gives.
Around each hit the alignment is verified over the whole item.

Scale: the index holds test items only, in blocks of at most ``BLOCK`` seeds,
each of which goes to the executors with its tasks; documents are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locuspark.llm.frames import columns, map_text, schema_of
from locuspark.llm.tokens import Runs, U, combine, raw

WINDOW, SHARE = 20, 0.8
#: Items of fewer tokens prove nothing (a parameter of every function).
LEAST = 5
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 5, 7, 8, 9), (0, 1, 5, 6, 8, 12))
#: Seeds of one block of the index; pairs of a hit and a place in an item that are held at once.
BLOCK, PAIRS = 1_000_000, 1 << 20


def seeds_for(n: int, window: int = WINDOW, share: float = SHARE) -> tuple[tuple[int, ...], ...]:
    """Masks that no item of ``n`` tokens can slip through."""
    if n >= window and (window, share) == (WINDOW, SHARE):
        return MASKS
    m = min(n, window)
    wrong = m - int(np.ceil(share * m - 1e-9))
    return (tuple(range(max(1, -(-(m - wrong) // (wrong + 1))))),)


class Index:
    """Seeds of test items, sorted by hash."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int = WINDOW, share: float = SHARE):
        self.window, self.share = window, share
        self.items = items
        self.masks: list[tuple[int, ...]] = sorted({m for _, h in items for m in seeds_for(len(h), window, share)})
        keys, item, place = [], [], []
        for i, (_, h) in enumerate(items):
            for mask in seeds_for(len(h), window, share):
                n = len(h) - mask[-1]
                if n > 0:
                    keys.append(combine([h[o : o + n] for o in mask], self.masks.index(mask) + 1))
                    item.append(np.full(n, i))
                    place.append(np.arange(n))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)
        self.bits = max(16, int(len(self.keys)).bit_length() + 5)
        self._sieve: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_sieve": None}  # made anew where it is used, so that it does not travel

    @property
    def sieve(self) -> np.ndarray:
        if self._sieve is None:
            self._sieve = np.zeros(1 << self.bits, bool)
            self._sieve[self.keys >> U(64 - self.bits)] = True
        return self._sieve

    def _pairs(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Different (document, item, start of the item in the slice) that share a seed, about ``PAIRS`` hits at a time."""
        for k, mask in enumerate(self.masks):
            n = len(h) - mask[-1]
            if n <= 0 or not len(self.keys):
                continue
            key = combine([h[o : o + n] for o in mask], k + 1)
            at = np.flatnonzero(self.sieve[key >> U(64 - self.bits)])
            lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
            at, lo, size = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total = np.cumsum(size)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
                many = size[a:b]
                which = np.repeat(lo[a:b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                hit = np.repeat(at[a:b], many)
                item, start, doc = self.item[which], hit - self.place[which], np.searchsorted(bounds, hit, "right") - 1
                order = np.lexsort((start, item, doc))
                item, start, doc = item[order], start[order], doc[order]
                new = np.ones(len(order), bool)
                new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (doc[1:] != doc[:-1])
                yield doc[new], item[new], start[new]
                a = b

    def find(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, item, matched, tokens, first, past) of the best window of each pair that passes.

        ``h``: token hashes of all documents; ``bounds``: where each begins.
        """
        best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for found in self._pairs(h, bounds):
            for d, i, s in zip(*(x.tolist() for x in found), strict=True):
                own = self.items[i][1]
                a, b = max(s, int(bounds[d])), min(s + len(own), int(bounds[d + 1]))
                m = min(self.window, len(own))
                if b - a < m:
                    continue
                same = np.concatenate([[0], np.cumsum(h[a:b] == own[a - s : b - s])])
                runs = same[m:] - same[:-m]
                if runs.max() + 1e-9 < self.share * m:
                    continue
                good = np.flatnonzero(runs + 1e-9 >= self.share * m)
                hits = int(same[-1])
                if (hits, -s) > best.get((d, i), (0, 0))[:2]:
                    best[d, i] = (hits, -s, m, a + int(good[0]), a + int(good[-1]) + m)
        for (d, i), (hits, _, m, a, b) in sorted(best.items()):
            yield d, i, hits, m, a, b


def blocks(benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most: int = BLOCK, least: int = LEAST) -> Iterator[Index]:
    """Indexes over all items, each of about ``most`` seeds; items with a null id or fewer than ``least`` tokens are left out."""
    rows: list[tuple[object, np.ndarray]] = []
    seeds = 0
    for row in columns(benchmark, "item_id", "text").where("item_id is not null and text is not null").dropDuplicates().toLocalIterator():
        runs = Runs(*raw(pa.array([row["text"]])))
        h = runs.words()
        if len(h) < max(least, 1):
            continue
        rows.append((row["item_id"], h))
        seeds += len(h) * len(seeds_for(len(h), window, share))
        if seeds >= most:
            yield Index(rows, window, share)
            rows, seeds = [], 0
    if rows:
        yield Index(rows, window, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most: int = BLOCK, least: int = LEAST) -> DataFrame:
    """One row per document and item that overlap: ``doc_id, item_id, n_matched, n_window, byte_start, byte_end, share``.

    n_matched counts agreeing tokens over the whole item on the best diagonal,
    share is that over the item's tokens; the span covers its passing windows,
    in bytes of the UTF-8 text. Null, empty and very short texts match nothing,
    an empty benchmark gives an empty table, repeated rows come back repeated; ids
    may be of any type;
    repeated items count once, items without an id or a text not at all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_matched int, n_window int, byte_start int, byte_end int, share double"

    def scan(index: Index) -> DataFrame:
        def fn(batch: pa.RecordBatch) -> dict | None:
            runs = Runs(*raw(batch.column("text")))
            rows = list(index.find(runs.words(), runs.bounds(batch.num_rows)))
            if not rows:
                return None
            d, i, hits, m, a, b = (np.array(x) for x in zip(*rows, strict=True))
            base = runs.offsets[d]
            size = np.array([len(index.items[k][1]) for k in i])
            return {"doc_id": batch.column("doc_id").take(pa.array(d)), "item_id": [index.items[k][0] for k in i], "n_matched": hits, "n_window": m, "byte_start": runs.start[a] - base, "byte_end": runs.end[b - 1] - base, "share": hits / size}

        return map_text(columns(docs, "doc_id", "text"), fn, schema)

    out = None
    for index in blocks(benchmark, window, share, most, least):
        out = scan(index) if out is None else out.union(scan(index))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most: int = BLOCK, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that no test item contaminates, with all their columns; null and empty texts stay."""
    schema = schema_of(docs)
    for index in blocks(benchmark, window, share, most, least):

        def fn(batch: pa.RecordBatch, index: Index = index) -> dict:
            runs = Runs(*raw(batch.column("text")))
            bad = {r[0] for r in index.find(runs.words(), runs.bounds(batch.num_rows))}
            left = batch.take(pa.array([k for k in range(batch.num_rows) if k not in bad], pa.int64()))
            return {c: left.column(c) for c in left.schema.names}

        docs = map_text(docs, fn, schema)
    return docs
