"""Hashed text features, a whole Arrow slice at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from locuspark.llm.tokens import Runs, U, combine, mixed, ngrams, raw


def _distinct(idx: list[np.ndarray], doc: list[np.ndarray], n_docs: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices document by document: indices and bounds."""
    key = np.concatenate([d.astype(np.int64) * dims + (h >> U(20)).astype(np.int64) % dims for h, d in zip(idx, doc, strict=True)])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key % dims).astype(np.int32), np.searchsorted(key, np.arange(n_docs + 1, dtype=np.int64) * dims)


def style(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of 1- and 2-grams of tokens and marks, and of 1- to 3-grams of their shapes.

    A shape says whether a run is a word or a mark, how it is capitalised,
    whether it has digits, and how long it is; for a mark, what it is. Also
    1- and 3-grams of whether a token repeats one of the three before it.
    """
    data, off = raw(col)
    runs = Runs(data, off, marks=True, lower=False)
    doc = runs.doc
    h = runs.words()
    upper = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    digit = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 48) & (data <= 57), out=digit[1:])
    long = np.minimum(runs.end - runs.start, 1 << 30)
    ups, digits = upper[runs.end] - upper[runs.start], digit[runs.end] - digit[runs.start]
    caps = np.where(ups == 0, 0, np.where((ups == long) & (long > 1), 3, np.where((ups == 1) & (data[runs.start] <= 90), 1, 2))) if len(h) else ups
    shape = (caps * 8 + np.minimum(digits, 1) * 4 + (long > 3) + (long > 12) * 1 + (long > 40) * 1).astype(U)
    shape = np.where(runs.mark, h, mixed(shape + U(77)))
    same = np.zeros(len(h), U)
    for back in (1, 2, 3):
        if len(h) > back:
            same[back:] |= ((h[back:] == h[:-back]) & (doc[back:] == doc[:-back])).astype(U) << U(back)
    again = mixed(same + U(1000))
    parts = [(again, doc), ngrams(again, doc, 3, 7), (h, doc), ngrams(h, doc, 2, 2), (shape, doc), ngrams(shape, doc, 2, 5), ngrams(shape, doc, 3, 6)]
    return _distinct([p[0] for p in parts], [p[1] for p in parts], len(col), dims)


def terms(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of lower-case words and of their first 4, 5, 6, 7 and 8 bytes."""
    data, off = raw(col)
    runs = Runs(data, off)
    long = runs.end - runs.start
    idx, doc = [runs.words()], [runs.doc]
    for n in (4, 5, 6, 7, 8):
        own = long >= n
        h = runs.hash(runs.start[own], runs.start[own] + n)
        idx.append(combine([h], 10 + n))
        doc.append(runs.doc[own])
    return _distinct(idx, doc, len(col), dims)
