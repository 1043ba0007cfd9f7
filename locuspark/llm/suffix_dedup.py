"""Exact removal of repeated byte strings across documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id.

Ordering every suffix of a corpus needs many times its size in shuffles
(:mod:`locuspark.llm.distributed_order` does it), so a sieve that misses
nothing runs first. Each window of ``LENGTH`` bytes is assigned its leftmost
least ``GRAM``-gram hash; consecutive windows with the same one form a context.
Equal windows choose the same gram at the same place, hence:

1. Contexts are dealt out by gram hash, packed (a gram of 48 + bucket bits, a
   context hash of 48 bits, the doc_id and an ordinal; under 20 bytes for every
   15 bytes of text). Copies inside a batch settle by their bytes before the
   shuffle. A context whose hash a smaller document shares claims to be covered
   whole, and one document vouches for it. What is left matters only if a
   smaller document has the same gram with another context: one document of
   each such context is asked for its bytes.
2. Those contexts are dealt out by gram. Of claims and vouchers a digest of 128
   bits of their bytes travels, and a claim holds only where both are equal;
   should one ever fail, all is done again with another hash. Of the others the
   bytes travel, a few per cent of the corpus; each task orders their suffixes
   by a difference cover, in bounded chunks, and compares adjacent prefixes.
   Grams with more than ``CROWD`` different contexts are dealt out as single
   windows by window hash instead, so that no group has to fit into one task.
3. Covered windows return to their documents.

A gram that very many different contexts share would fill one task. Such hot
grams are found beforehand in a sample of documents, at least ``SAMPLE`` and a
share of ``DENSE`` of all (so that a gram of two million contexts is seen at any
size of corpus, but for a chance of 1e-7), and their contexts are cut into
single windows, each with hashes of its own. Whichever grams are chosen, equal
windows go the same way, so the result does not depend on it. Tasks and buckets
follow from the bytes of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.difference_cover import same_prefixes
from locuspark.llm.frames import columns, partitions, slices, trimmed, written
from locuspark.llm.tokens import ROOT, U, mixed, powers, raw

LENGTH, GRAM = 50, 20
#: Different contexts of a gram up to which they are compared in one task.
CROWD = 4096
#: Documents of the sample that hot grams are looked for in, and different contexts there that make a gram hot.
SAMPLE, HOT = 8192, 12
#: Share of the documents that the sample has at least, and bytes of text for each task of a shuffle.
DENSE, TASK = 4e-5, 128 << 20
#: Contexts gathered before a batch of them is dealt out; bytes that are ordered at once.
BATCH, CHUNK = 400_000, 400_000
#: Bytes of texts that are looked at together, and of one long text (more than the former, so that it comes alone).
SLICE, PIECE = 1 << 18, 1 << 20
#: Bytes of contexts gathered before they are dealt out with their texts.
SENT = 4 << 20
COVERED, ASKS, GIVES, ASKS_APART, GIVES_APART, CLAIMS, VOUCHES = range(7)
SIX, PLACE = U((1 << 48) - 1), U((1 << 32) - 1)


class Contexts:
    """Contexts of a slice: document, first and last window, gram hash, context hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None, piece: int = PIECE, root: int = ROOT):
        self.data, self.off, self.length, self.piece, self.root = data, off, length, piece, root
        self._held: dict[int, tuple[int, np.ndarray]] = {}
        none = np.zeros(0, np.int64)
        self.doc = self.lo = self.hi = none
        self.gram = self.hash = np.zeros(0, U)
        n_windows = len(data) - length + 1
        if n_windows < 1:
            return
        # Long texts go piece by piece; a context that two pieces share becomes two.
        found = [self._found(a, min(a + piece, n_windows), gram, hot) for a in range(0, n_windows, piece)]
        self.lo, self.hi, self.gram, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = np.searchsorted(off, self.lo, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(off) - 1))
        self.ordinal = np.arange(len(self.doc)) - self.first[self.doc]

    def _sums(self, a: int, root: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the piece from ``a``, and powers that shift any range to its start."""
        root = root or self.root
        data = self.data[a : a + self.piece + self.length - 1]
        up, down = powers(len(data) + 1, root)
        if self._held.get(root, (-1,))[0] != a:
            sums = np.zeros(len(data) + 1, U)
            with np.errstate(over="ignore"):
                np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
            self._held[root] = (a, sums)
        return self._held[root][1], down

    def _found(self, a: int, b: int, gram: int, hot: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """The contexts of the windows that start from ``a`` to before ``b``."""
        length, w, n = self.length, self.length - gram + 1, b - a
        sums, down = self._sums(a)
        ends = n + length - gram
        with np.errstate(over="ignore"):
            grams = mixed((sums[gram : gram + ends] - sums[:ends]) * down[:ends])
        # The least of each window by the upper half of its hash, the leftmost of ties: value and place in one word.
        least, span = (grams & ~PLACE) | np.arange(ends, dtype=U), 1
        while span < w:
            step = min(span, w - span)
            least = np.minimum(least[step:], least[:-step])
            span += step
        at = (least & PLACE).astype(np.int64)
        first, past = np.searchsorted(self.off, a, "right") - 1, np.searchsorted(self.off, b - 1, "right")
        own = np.clip(self.off[first : past + 1], a, b)
        whole = np.arange(a + length, b + length) <= np.repeat(self.off[first + 1 : past + 1], np.diff(own))
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
        last = whole.copy()
        last[:-1] &= ~whole[1:] | new[1:]
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        place = at[lo]
        key = grams[place]
        with np.errstate(over="ignore"):
            ctx = mixed((sums[hi + length] - sums[lo]) * down[lo] ^ ((hi - lo).astype(U) << U(32)) ^ (place - lo).astype(U))
        lo, hi = lo + a, hi + a
        if hot is None or not len(hot):
            return lo, hi, key, ctx
        # Contexts of hot grams become single windows, in their order.
        apart = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        size = np.where(apart, hi - lo + 1, 1)
        of = np.repeat(np.arange(len(size)), size)
        single, each = apart[of], _ragged(lo, size)
        key, ctx = key[of], ctx[of]
        key[single], ctx[single] = self.windows(each[single]), self.windows(each[single], self.root * 5 & (1 << 64) - 1)
        return each, np.where(single, each, hi[of]), key, ctx

    def windows(self, lo: np.ndarray, root: int | None = None) -> np.ndarray:
        """Hashes of the windows that start at ``lo``, by powers of a root of its own if so wished."""
        out = np.empty(len(lo), U)
        for p in np.unique(lo // self.piece).tolist():
            a = p * self.piece
            own = lo // self.piece == p
            sums, down = self._sums(a, root)
            at = lo[own] - a
            with np.errstate(over="ignore"):
                out[own] = mixed((sums[at + self.length] - sums[at]) * down[at])
        return out


def _planes(a: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each value, one plane after the other: constant planes compress to nothing."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(buf: memoryview, n: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 4
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(buf, np.uint8, n * width, at).reshape(width, n).T
        out.append(full.view("<u8").ravel())
        at += n * width
    return out


def _pack(fields: list[tuple[np.ndarray, int]]) -> bytes:
    return len(fields[0][0]).to_bytes(4, "little") + b"".join(_planes(a, w) for a, w in fields)


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Group number along ``order`` of rows with equal keys."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return np.cumsum(new)


def _first(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row, a row of the smallest doc among those with equal keys.

    Rows are sorted by one mixed key; where different keys mix to the same, a
    row may get the smallest of a part of its equals.
    """
    one = keys[0]
    for k in keys[1:]:
        one = mixed(one ^ k)
    order = np.argsort(one)
    group = _groups(order, *keys)
    out = np.empty(len(doc), np.int64)
    if len(doc):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(doc[order], start)[group] == doc[order]
        out[order] = np.maximum.reduceat(np.where(least, order, -1), start)[group]
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` are the same; about ``most`` bytes are looked at at once."""
    out = np.zeros(len(a), bool)
    total = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        own = size[i:j]
        out[i:j] = np.logical_and.reduceat(data[_ragged(a[i:j], own)] == data[_ragged(b[i:j], own)], np.cumsum(own) - own)
        i = j
    return out


_WIDTHS = (6, 6, 8, 4, 4)
_FOUND = "bucket int, kind int, payload binary"
#: What a payload for documents holds: codes of contexts, first bytes of covered windows, or claims that failed.
CODES, WINDOWS, FAILED = range(3)
_FOUND_WIDTHS = (8, 4, 5)


def _by_document(doc: np.ndarray, sub: np.ndarray, code: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Codes by bucket of documents."""
    rows = [(b, kind, _pack([(x[k], w) for x, w in zip((doc, sub, code), _FOUND_WIDTHS, strict=True)])) for b, k in _cut((mixed(doc.astype(U) ^ mixed(sub.astype(U))) % U(buckets)).astype(np.int64))]
    if rows:
        b, kinds, payload = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "kind", "payload"])


_COLLECTED = "doc_id long, sub int, found binary, single binary"


def _collect(answers: bool):
    """Payloads of each bucket to one row a document; ``answers``: without the codes that are none."""

    def words(held: list[tuple[int, bytes]], kind: int) -> dict[tuple[int, int], bytes]:
        fields = [_values(memoryview(p), int.from_bytes(p[:4], "little"), _FOUND_WIDTHS) for k, p in held if k == kind]
        if not fields:
            return {}
        doc, sub, code = (np.concatenate(x).view(np.int64) for x in zip(*fields, strict=True))
        if answers and kind == CODES:
            doc, sub, code = (x[code & 7 == COVERED] for x in (doc, sub, code))
        order = np.lexsort((code, sub, doc))
        doc, sub, code = doc[order], sub[order], code[order]
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]), [True]])) if len(doc) else np.zeros(1, int)
        return {(int(doc[a]), int(sub[a])): code[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(it):
            found, single = words(held, CODES), words(held, WINDOWS)
            names = sorted(found.keys() | single.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in names], pa.int64()), pa.array([s for _, s in names], pa.int32()), pa.array([found.get(n) for n in names], pa.binary()), pa.array([single.get(n) for n in names], pa.binary())], names=["doc_id", "sub", "found", "single"]
            )

    return run


def sized(texts: DataFrame) -> tuple[int, int]:
    """Documents that have a text, and the bytes of those."""
    row = texts.where("doc_id is not null and text is not null").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row["n"], row["b"] or 0


def hot_grams(texts: DataFrame, length: int, gram: int, share: float, least: int, root: int = ROOT) -> np.ndarray:
    """Gram hashes with at least ``least`` different contexts in that share of the ``texts``, sorted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, most=SLICE):
            c = Contexts(*raw(batch.column("text")), length, gram, root=root)
            pair = np.unique(np.stack([c.gram, c.hash]), axis=1) if len(c.gram) else np.zeros((2, 0), U)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], names=["gram", "hash"])

    some = texts.where("doc_id is not null and text is not null").select("text")
    found = some.sample(min(1.0, share), 29).mapInArrow(run, "gram long, hash long").distinct().groupBy("gram").count().where(F.col("count") >= least)
    return np.sort(np.array([r["gram"] for r in found.select("gram").toLocalIterator()], np.int64).view(U))  # bounded by the sample


def _deal(length: int, gram: int, buckets: int, hot: np.ndarray, root: int = ROOT):
    """Texts to packed contexts by bucket; what a batch settles by itself goes along with kind 1."""

    def send(parts: list) -> Iterator[pa.RecordBatch]:
        grams, hashes, doc, sub, ordinal, begin, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        first = _first(doc, grams, hashes)
        settled = np.flatnonzero((doc > doc[first]) & (size == size[first]))
        settled = settled[same_bytes(data, begin[settled], begin[first[settled]], size[settled])]
        rows: list[tuple[int, int, bytes]] = []
        d, s, o = doc[settled], sub[settled], ordinal[settled]
        for b, k in _cut((mixed(d.astype(U)) % U(buckets)).astype(np.int64)):
            rows.append((b, 1, _pack([(d[k], 8), (s[k], 4), (o[k], 4)])))
        left = np.delete(np.arange(len(doc)), settled)
        for b, k in _cut(((grams[left] >> U(48)) % U(buckets)).astype(np.int64)):
            k = left[k]
            rows.append((b, 0, _pack([(grams[k], 6), (hashes[k] & SIX, 6), (doc[k], 8), (sub[k], 4), (ordinal[k], 4)])))
        b, kind, payload = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "kind", "payload"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, held = [], 0, 0
        for batch in slices(it, most=SLICE):
            c = Contexts(*raw(batch.column("text")), length, gram, hot, root=root)
            if not len(c.doc):
                continue
            ids, subs = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("sub").to_numpy(zero_copy_only=False)
            parts.append((c.gram, c.hash, ids[c.doc].astype(np.int64), subs[c.doc].astype(np.int64), c.ordinal, c.lo + held, c.hi - c.lo + length, c.data))
            n, held = n + len(c.doc), held + len(c.data)
            if n >= BATCH:
                yield from send(parts)
                parts, n, held = [], 0, 0
        if parts:
            yield from send(parts)

    return run


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else [0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _by_bucket(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The payloads of each bucket, of rows sorted by bucket."""
    now, held = None, []
    for batch in it:
        for b, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append((kind, payload))
    if held:
        yield now, held


def _settle(crowd: int, buckets: int):
    """Contexts of each bucket to what their documents need to know."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for _, held in _by_bucket(it):
            known = [_values(memoryview(p), int.from_bytes(p[:4], "little"), (8, 4, 4)) for k, p in held if k]
            for d, s, o in known:
                out.append((d.view(np.int64), s.view(np.int64), o.view(np.int64) << 3 | COVERED))
            rows = [_values(memoryview(p), int.from_bytes(p[:4], "little"), _WIDTHS) for k, p in held if not k]
            if rows:
                gram, ctx, doc, sub, ordinal = (np.concatenate(x) for x in zip(*rows, strict=True))
                doc, sub, ordinal = doc.view(np.int64), sub.view(np.int64), ordinal.view(np.int64)
                order = np.lexsort((doc, ctx, gram))
                g, c = _groups(order, gram), _groups(order, gram, ctx)
                d = doc[order]
                start = np.searchsorted(c, np.arange(c[-1] + 1))
                low_c = d[start]  # smallest document of each context
                of_c = g[start]  # its gram
                low_g = np.full(g[-1] + 1, np.iinfo(np.int64).max)
                np.minimum.at(low_g, of_c, low_c)
                many = np.bincount(of_c)
                claims = d > low_c[c]
                asks = ~claims & (d > low_g[g])
                asked = np.zeros(g[-1] + 1, bool)
                asked[g[asks]] = True
                once = np.zeros(len(d), bool)
                once[start] = True
                gives = ~claims & ~asks & asked[g] & once
                claimed = np.zeros(len(start), bool)
                claimed[c[claims]] = True
                vouches = once & claimed[c]
                apart = many[g] > crowd
                code = np.where(claims, CLAIMS, np.where(asks, np.where(apart, ASKS_APART, ASKS), np.where(apart, GIVES_APART, GIVES)))
                for keep, what in ((claims | asks | gives, code), (vouches, np.full(len(d), VOUCHES))):
                    own = order[keep]
                    out.append((doc[own], sub[own], ordinal[own] << 3 | what[keep]))
            n = sum(len(x[0]) for x in out)
            if n > BATCH:
                yield from _by_document(*(np.concatenate(x) for x in zip(*out, strict=True)), CODES, buckets)
                out, n = [], 0
        if out:
            yield from _by_document(*(np.concatenate(x) for x in zip(*out, strict=True)), CODES, buckets)

    return run


def _ragged(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start at ``lo``."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _codes(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(p or b"", "<i8") for p in batch.column(column).to_pylist()]


def _travelling(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their texts compressed, so that they are shuffled so."""
    import zstandard

    small = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for batch in it:
        col = batch.column("text")
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sub"), pa.array([None if t is None else small.compress(t) for t in col.to_pylist()], pa.binary())], names=["doc_id", "sub", "text"])


def _arrived(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bounded batches with their texts whole again."""
    import zstandard

    large = zstandard.ZstdDecompressor()
    for batch in slices(it, most=SLICE // 2):
        text = pa.array([None if t is None else large.decompress(t) for t in batch.column("text").to_pylist()], pa.large_binary())
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names=names)


_CLAIM_WIDTHS = (8, 8, 8, 8, 4, 4, 1)


def _fetch(length: int, gram: int, buckets: int, hot: np.ndarray, root: int = ROOT):
    """Documents that are asked for contexts to the bytes of those (kind 0), or their digests (kind 1), by bucket."""

    def send(parts: list, kind: int) -> Iterator[pa.RecordBatch]:
        key, *fields = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        for b, k in _cut(((key >> U(48)) % U(buckets)).astype(np.int64)):
            k = k[np.argsort(key[k], kind="stable")]
            if kind:
                payload = _pack([(x[k], w) for x, w in zip((key, *fields), _CLAIM_WIDTHS, strict=True)])
            else:
                ids, subs, lo, size, asks, at, text = fields
                payload = _pack([(key[k], 8), (ids[k], 8), (subs[k], 4), (lo[k], 4), (size[k], 4), (asks[k], 1)]) + text[_ragged(at[k], size[k])].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "kind", "payload"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, claims, n_claims, base = [], 0, [], 0, 0
        for batch in _arrived(it):
            codes = _codes(batch, "found")
            need = [k for k, c in enumerate(codes) if len(c) and (c & 7 != COVERED).any()]
            if not need:
                continue
            batch = batch.take(pa.array(need))
            ctx = Contexts(*raw(batch.column("text")), length, gram, hot, root=root)
            ids, subs = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("doc_id", "sub"))
            at, kind = [], []
            for row, k in enumerate(need):
                c = codes[k][codes[k] & 7 != COVERED]
                at.append(ctx.first[row] + (c >> 3))
                kind.append(c & 7)
            at, kind = np.concatenate(at), np.concatenate(kind)
            sworn = kind >= CLAIMS
            if sworn.any():
                own, doc = at[sworn], ctx.doc[at[sworn]]
                text = ctx.data.tobytes()
                digest = np.frombuffer(b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(ctx.lo[own].tolist(), (ctx.hi[own] + length).tolist(), strict=True)), "<u8").reshape(-1, 2)
                claims.append((ctx.gram[own], digest[:, 0].copy(), digest[:, 1].copy(), ids[doc], subs[doc], ctx.ordinal[own], (kind[sworn] == CLAIMS).astype(np.uint8)))
                n_claims += len(own)
                at, kind = at[~sworn], kind[~sworn]
            if len(at):
                lo, hi, key, doc = ctx.lo[at], ctx.hi[at], ctx.gram[at], ctx.doc[at]
                alone = kind >= ASKS_APART
                if alone.any():  # one row a window, by its own hash
                    size = (hi - lo + 1)[alone]
                    each = _ragged(lo[alone], size)
                    lo, hi = np.concatenate([lo[~alone], each]), np.concatenate([hi[~alone], each])
                    key = np.concatenate([key[~alone], ctx.windows(each)])
                    doc = np.concatenate([doc[~alone], np.repeat(doc[alone], size)])
                    kind = np.concatenate([kind[~alone], np.repeat(kind[alone] - 2, size)])
                size = hi - lo + length
                total = int(size.sum())
                parts.append((key, ids[doc], subs[doc], lo - ctx.off[doc], size, (kind == ASKS).astype(np.uint8), base + np.cumsum(size) - size, ctx.data[_ragged(lo, size)]))
                base += total
                held += total + 40 * len(size)
            if held > SENT:
                yield from send(parts, 0)
                parts, held, base = [], 0, 0
            if n_claims > BATCH // 4:
                yield from send(claims, 1)
                claims, n_claims = [], 0
        if parts:
            yield from send(parts, 0)
        if claims:
            yield from send(claims, 1)

    return run


def _sworn(held: list[bytes]) -> tuple[np.ndarray, ...]:
    """document, sub, ordinal and whether it holds, of each claim: a smaller document has the very bytes."""
    fields = [_values(memoryview(p), int.from_bytes(p[:4], "little"), _CLAIM_WIDTHS) for p in held]
    key, one, two, doc, sub, ordinal, claim = (np.concatenate(x) for x in zip(*fields, strict=True))
    doc = doc.view(np.int64)
    order = np.lexsort((doc, two, one, key))
    group = _groups(order, key, one, two)
    low = doc[order][np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))][group]
    own = claim[order] > 0
    k = order[own]
    return doc[k], sub[k].view(np.int64), ordinal[k].view(np.int64), doc[k] > low[own]


def _order(length: int, chunk: int, buckets: int):
    """Claims and contexts with their bytes, by bucket, to covered contexts and the covered windows of those that asked."""
    widths = (8, 8, 4, 4, 4, 1)

    def compare(doc, sub, lo, size, asks, text_at, text) -> tuple | None:
        data = text[_ragged(text_at, size)]
        begin = np.cumsum(size) - size
        n_windows = size - length + 1
        starts = _ragged(begin, n_windows)
        owner = np.repeat(np.arange(len(doc)), n_windows)
        label = same_prefixes(data, starts, length)
        low = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, label, doc[owner])
        hit = asks[owner] & (low[label] < doc[owner])
        if not hit.any():
            return None
        own = owner[hit]
        return doc[own], sub[own], lo[own] + (starts[hit] - begin[own])

    def send(answers: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for kind, parts in answers.items():
            if parts:
                yield from _by_document(*(np.concatenate(x) for x in zip(*parts, strict=True)), kind, buckets)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list[tuple]] = {k: [] for k in (CODES, WINDOWS, FAILED)}
        for _, held in _by_bucket(it):
            if sum(len(x[0]) for kind in answers.values() for x in kind) > BATCH:
                yield from send(answers)
                answers = {k: [] for k in answers}
            if sworn := [p for k, p in held if k]:
                doc, sub, ordinal, holds = _sworn(sworn)
                for part, kind in ((holds, CODES), (~holds, FAILED)):
                    answers[kind].append((doc[part], sub[part], ordinal[part] << 3 | COVERED))
            held = [p for k, p in held if not k]
            if not held:
                continue
            heads, texts, base = [], [], 0
            for p in held:
                n = int.from_bytes(p[:4], "little")
                heads.append([*_values(memoryview(p), n, widths)])
                body = np.frombuffer(p, np.uint8, offset=4 + n * sum(widths))
                size = heads[-1][4].view(np.int64)
                heads[-1].append((base + np.cumsum(size) - size).view("<u8"))
                texts.append(body)
                base += len(body)
            key, doc, sub, lo, size, asks, at = (np.concatenate(x) for x in zip(*heads, strict=True))
            text = np.concatenate(texts)
            doc, sub, lo, size, at, asks = doc.view(np.int64), sub.view(np.int64), lo.view(np.int64), size.view(np.int64), at.view(np.int64), asks > 0
            order = np.lexsort((doc, key))
            ends = np.flatnonzero(np.concatenate([key[order][1:] != key[order][:-1], [True]])) + 1  # groups stay whole
            total = np.cumsum(size[order])
            a = 0
            while a < len(order):
                b = int(ends[min(np.searchsorted(total[ends - 1], (total[a - 1] if a else 0) + chunk, "right"), len(ends) - 1)])
                k = order[a:b]
                if asks[k].any() and (got := compare(doc[k], sub[k], lo[k], size[k], asks[k], at[k], text)):
                    answers[WINDOWS].append(got)
                a = b
        yield from send(answers)

    return run


def _finish(length: int, gram: int, hot: np.ndarray, root: int = ROOT):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _arrived(it):
            found, single = _codes(batch, "found"), _codes(batch, "single")
            col = batch.column("text")
            data, off = raw(col)
            size = np.diff(off)
            gone, spans, digest = [], [], []
            need = np.array([k for k, c in enumerate(found) if (c & 7 == COVERED).any()], int)
            ctx = Contexts(*raw(col.take(pa.array(need))), length, gram, hot, root=root) if len(need) else None
            place = {k: i for i, k in enumerate(need.tolist())}
            for k in range(batch.num_rows):
                own = data[off[k] : off[k + 1]]
                edge = None
                if k in place or len(single[k]):
                    edge = np.zeros(size[k] + 1, np.int32)
                    if k in place:
                        c = found[k][found[k] & 7 == COVERED] >> 3
                        at = ctx.first[place[k]] + c
                        base = ctx.off[place[k]]
                        np.add.at(edge, ctx.lo[at] - base, 1)
                        np.add.at(edge, ctx.hi[at] - base + length, -1)
                    np.add.at(edge, single[k], 1)
                    np.add.at(edge, single[k] + length, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone.append(int(out.sum()))
                    spans.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                    digest.append(hashlib.sha256(own[~out].tobytes()).hexdigest())
                else:
                    gone.append(0)
                    spans.append(0)
                    digest.append(hashlib.sha256(own.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, sub, text``: sub tells different texts of one doc_id apart (0 where ids do not repeat)."""
    own = columns(docs, "doc_id", "text")
    repeated = own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return own.select("doc_id", F.lit(0).alias("sub"), "text")
    texts = own.join(repeated, "doc_id", "left_semi").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).distinct()
    texts = texts.groupBy("doc_id").agg(F.sort_array(F.collect_set("sha")).alias("all")).select("doc_id", F.posexplode("all").alias("sub", "sha"))
    keyed = own.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(texts, ["doc_id", "sha"], "left")
    return keyed.select("doc_id", F.coalesce("sub", F.lit(0)).alias("sub"), "text")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, chunk: int = CHUNK, sample: int = SAMPLE, least: int = HOT, root: int = ROOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)``.

    doc_id is an integer. Null texts are empty; a null doc_id is neither
    smaller nor larger than any other, so its row stays whole and removes
    nothing; rows of one doc_id do not remove from each other; repeated rows
    come back repeated; texts of fewer than ``length`` bytes stay whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer, not {kind}")
    texts = numbered(docs)
    rows, size = sized(texts)
    n = max(partitions(docs.sparkSession), -(-size // TASK))
    buckets, asked_for, shelves = 8 * n, 2 * n, max(1, n // 4)  # of all contexts, of those that are asked for, and of documents
    hot = hot_grams(texts, length, gram, max(sample / max(1, rows), DENSE), least, root)
    dealt = texts.where("doc_id is not null and text is not null").mapInArrow(trimmed(_deal(length, gram, buckets, hot, root)), _FOUND)
    by_bucket = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    found = written(by_bucket(dealt).mapInArrow(trimmed(_settle(crowd, shelves)), _FOUND), "contexts")
    spread = texts.mapInArrow(trimmed(_travelling), f"doc_id {kind}, sub int, text binary").repartition(n, "doc_id", "sub")  # both joins below take this exchange
    told = by_bucket(found).mapInArrow(trimmed(_collect(False)), _COLLECTED)
    asked = spread.join(told, ["doc_id", "sub"], "left").select("doc_id", "sub", "text", "found")
    fetched = asked.mapInArrow(trimmed(_fetch(length, gram, asked_for, hot, root)), _FOUND)
    ordered = written(by_bucket(fetched).mapInArrow(trimmed(_order(length, chunk, shelves)), _FOUND), "answers")
    if not ordered.where(F.col("kind") == FAILED).isEmpty():  # different contexts had one hash
        return deduplicated(docs, length, gram, crowd, chunk, sample, least, root * 25 & (1 << 64) - 1)
    told = by_bucket(found.unionByName(ordered)).mapInArrow(trimmed(_collect(True)), _COLLECTED)
    both = spread.join(told, ["doc_id", "sub"], "left").select("doc_id", "text", "found", "single")
    return both.mapInArrow(trimmed(_finish(length, gram, hot, root)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
