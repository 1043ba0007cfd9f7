"""Suffix order by a difference cover modulo 3, with numpy.

The suffixes at positions 1 and 2 modulo 3 are the sample: their triples are
sorted and named, the string of names is ordered recursively, and the remaining
suffixes, whose successors are in the sample, are sorted by one symbol and a
rank and merged in. ``enough`` cuts the recursion as soon as names stand for
that many symbols; suffixes that agree so far may then come in any order.
"""

from __future__ import annotations

import numpy as np

#: Symbols and ranks are packed three to a word, 21 bits each.
LONGEST = (1 << 21) - 8


def ranks(s: np.ndarray, enough: int, width: int = 1) -> np.ndarray:
    """The place of each suffix of ``s`` (values of 1 and more, at most 2**21) in suffix order.

    ``width``: symbols of the original string that one value stands for.
    """
    n = len(s)
    if n > LONGEST:
        raise ValueError(f"{n} symbols; a call takes {LONGEST} at most")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64).argsort()
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # one of the first past the end, if it must part the two halves
    sample = np.concatenate([ones, twos])
    key = (t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2]
    order = np.argsort(key)  # equal triples get one name, or may come in any order
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    if new.all() or 3 * width >= enough:
        place = np.empty(len(sample), np.int64)
        place[order] = np.arange(len(sample))
    else:
        name = np.empty(len(sample), np.int64)
        name[order] = np.cumsum(new)
        place = ranks(name, enough, 3 * width)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = place + 1
    rank[n + 1 :] = 0
    zeros = np.arange(0, n, 3)
    by_one = (t[zeros] << 21) | rank[zeros + 1]
    own = np.argsort(by_one)
    zeros, by_one = zeros[own], by_one[own]
    by_two = (t[zeros] << 42) | (t[zeros + 1] << 21) | rank[zeros + 2]
    in_order = sample[np.argsort(place)]  # where the recursion was cut, ranks can be equal
    in_order = in_order[in_order < n]  # without the one past the end
    one, two = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    one_key = (t[one] << 21) | rank[one + 1]
    two_key = (t[two] << 42) | (t[two + 1] << 21) | rank[two + 2]
    out = np.empty(n, np.int64)
    out[zeros] = np.arange(len(zeros)) + np.searchsorted(one_key, by_one) + np.searchsorted(two_key, by_two)
    before = np.empty(n, np.int64)
    before[one] = np.searchsorted(by_one, one_key, "right")
    before[two] = np.searchsorted(by_two, two_key, "right")
    out[in_order] = np.arange(len(in_order)) + before[in_order]
    return out


def same_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class number for each of ``starts``: equal where the ``length`` bytes from there are equal.

    Every start has ``length`` bytes before the end of ``data``. Suffixes are
    ordered, and adjacent prefixes compared. More than ``LONGEST`` symbols are
    ordered by a hash of the prefix instead.
    """
    if len(data) > LONGEST:
        return same_windows(data, starts, length)
    place = ranks(data.astype(np.int64) + 1, length)
    order = starts[np.argsort(place[starts])]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    equal = np.ones(max(len(order) - 1, 0), bool)
    at = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for k in at:
        w = np.ascontiguousarray(words[order + k]).view(np.uint64).ravel()
        equal &= w[1:] == w[:-1]
    for k in range(length if length < 8 else 0):
        equal &= data[order[1:] + k] == data[order[:-1] + k]
    label = np.empty(len(data), np.int64)
    label[order] = np.cumsum(np.concatenate([[0], ~equal])) if len(order) else 0
    return label[starts]


def same_windows(data: np.ndarray, starts: np.ndarray, length: int, block: int = 1 << 18) -> np.ndarray:
    """What :func:`same_prefixes` gives, for data of any size: hashes gather windows, bytes decide."""
    from locuspark.llm.tokens import mixed

    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    at = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    key = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), block):
        own, h = starts[i : i + block], np.zeros(len(starts[i : i + block]), np.uint64)
        for k in at:
            h = mixed(h ^ np.ascontiguousarray(words[own + k]).view(np.uint64).ravel())
        for k in range(length if length < 8 else 0):
            h = mixed(h ^ data[own + k].astype(np.uint64))
        key[i : i + block] = h
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.cumsum(new) - 1
    # A group in which neighbours differ holds several windows of one hash: these are told apart by their bytes.
    clash = set()
    for i in range(1, len(order), block):
        a, b = starts[order[i - 1 : i + block - 1]], starts[order[i : i + block]]
        a, same = a[: len(b)], ~new[i : i + block]
        differ = np.zeros(len(b), bool)
        for k in range(length):
            differ |= data[a + k] != data[b + k]
        clash.update(group[i : i + block][same & differ].tolist())
    label = np.empty(len(starts), np.int64)
    label[order] = group
    past = int(group[-1]) + 1 if len(group) else 0
    for g in sorted(clash):
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(label == g).tolist():
            label[k] = seen.setdefault(data[starts[k] : starts[k] + length].tobytes(), past + len(seen))
        past += len(seen)
    return label
