"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprint: each bit is the strict majority over the XXH64 of all 4-word
shingles. Bit position i of the 64 gets a non-zero vector m(i) in
GF(2)**(radius+1); table v (each non-zero v) keeps the bits whose m(i) has an
odd product with v. The at most ``radius`` vectors of differing bits cannot
span the space, so some v is orthogonal to all of them, and in that table the
pair's masked fingerprints are equal: no pair within the radius is missed.

Scale: equal fingerprints collapse before anything else; tables are dealt by
masked value, 16 bytes a row. A bucket is solved in its task and gives a
spanning forest, never all pairs. Buckets above ``MOST`` distinct fingerprints
go another way, linear in their size: two fingerprints within 4 bits have a
common word within 2 bits of each, so all words within 2 bits of each are dealt
out and those that meet are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.components import components
from locuspark.llm.frames import columns, map_text, partitions, unused, written

RADIUS = 4
#: Distinct fingerprints of a bucket that one task compares with each other.
MOST = 4096
#: Rows of a fingerprint from which its component's name is broadcast.
HOT = 1_000_000
SHINGLE = 4
#: Words of a text above which it is fingerprinted in pieces.
LONG = 1 << 14
U = np.uint64


def masks(radius: int = RADIUS) -> list[int]:
    """The bit mask of each table."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if bin(vector[i] & v).count("1") % 2) for v in range(1, top)]


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """SimHash of each UTF-8 text, as uint64; no words: zero."""
    from functools import partial

    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=42)
    out = np.zeros(len(texts), U)
    shingles: list[bytes] = []
    at = [0]
    for k, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if n > LONG:  # in pieces, so that memory does not hold every shingle
            ones = np.zeros(64, np.int64)
            for i in range(0, n - size + 1, LONG):
                own = words[i : i + LONG + size - 1]
                h = np.fromiter(map(digest, map(b" ".join, zip(*(own[j:] for j in range(size)), strict=False))), U)
                ones += _bits(h).sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(ones * 2 > n - size + 1, bitorder="little").view(U)[0]
        elif n >= size:
            shingles += map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        elif n:
            shingles.append(b" ".join(words))
        at.append(len(shingles))
    if not shingles:
        return out
    bits = _bits(np.fromiter(map(digest, shingles), U, len(shingles)))
    at = np.array(at)
    full = np.flatnonzero(at[1:] > at[:-1])
    ones = np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
    major = ones * 2 > (at[full + 1] - at[full])[:, None]
    out[full] = np.packbits(major, axis=1, bitorder="little").view(U).ravel()
    return out


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest of its component, member) among distinct fingerprints."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    more = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[more]], fps[more]


def _runs(it: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, value, is part of a run longer than ``most``) of rows sorted by key, runs whole unless so long."""
    keys, vals, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in it:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        vals = np.concatenate([vals, batch.column(1).to_numpy(zero_copy_only=False)])
        if long_key is not None:
            other = keys != long_key
            n = int(np.argmax(other)) if other.any() else len(keys)
            yield keys[:n], vals[:n], True
            keys, vals = keys[n:], vals[n:]
            if not len(keys):
                continue
            long_key = None
        tail = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
        if tail:
            yield keys[:tail], vals[:tail], False
            keys, vals = keys[tail:], vals[tail:]
        if len(keys) > most:
            long_key = keys[0]
            yield keys, vals, True
            keys, vals = keys[:0], vals[:0]
    if len(keys):
        yield keys, vals, long_key is not None


def _bucket_links(radius: int, most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, vals, long in _runs(it, most):
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            hot: list[np.ndarray] = []
            if long:
                hot.append(vals)
            else:
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
                size = np.diff(at)
                fps = vals.view(U)
                few = np.repeat(size <= 8, size)
                for s in range(1, 8):
                    i = np.flatnonzero((keys[s:] == keys[:-s]) & few[s:])
                    if not len(i):
                        break
                    i = i[np.bitwise_count(fps[i] ^ fps[i + s]) <= radius]
                    a.append(vals[i])
                    b.append(vals[i + s])
                for k in np.flatnonzero(size > 8):
                    own = fps[at[k] : at[k + 1]]
                    if len(own) > most:
                        hot.append(own.view(np.int64))
                        continue
                    x, y = forest(own, radius)
                    a.append(x.view(np.int64))
                    b.append(y.view(np.int64))
            for x, y, h in ((a, b, False), (hot, hot, True)):
                if x and (x := np.concatenate(x)).size:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.concatenate(y)), pa.array(np.full(len(x), h))], names=["a", "b", "hot"])

    return run


def _balls(radius: int):
    """All words within half the radius (rounded up) of each fingerprint."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([sum(1 << i for i in c) for k in range((radius + 1) // 2 + 1) for c in combinations(range(64), k)], U)
        for batch in it:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for i in range(0, len(fps), 64):
                part = fps[i : i + 64]
                mid = (part[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part.view(np.int64), len(flips)))], names=["mid", "fp"])

    return run


def _stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: each value with the first of its key."""
    key = first = None
    for batch in it:
        if not batch.num_rows:
            continue
        k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        root = np.where(at >= 0, v[np.maximum(at, 0)], first if first is not None else 0)
        key, first = k[-1], root[-1]
        more = root != v
        yield pa.RecordBatch.from_arrays([pa.array(root[more]), pa.array(v[more])], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """``distinct(fp)`` to links ``(a, b)`` that connect exactly what is within the radius, directly or by others."""
    keep = masks(radius)
    n = partitions(distinct.sparkSession)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from locuspark.llm.tokens import mixed

        for batch in it:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for t, mask in enumerate(keep):
                with np.errstate(over="ignore"):
                    key = mixed((fps & U(mask)) + U((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps.view(np.int64))], names=["key", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "key long, fp long")
    found = written(dealt.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(radius, most), "a long, b long, hot boolean"), "links")
    out = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    if not found.where("hot").isEmpty():
        mids = hot.mapInArrow(_balls(radius), "mid long, fp long")
        out = out.union(mids.repartition(n, "mid").sortWithinPartitions("mid", "fp").mapInArrow(_stars, "a long, b long"))
    return out.distinct()


def fingerprint_column(docs: DataFrame, text: str = "text", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``extra`` columns and ``fp`` (the fingerprint as a signed long)."""

    def fn(batch: pa.RecordBatch) -> dict:
        col = batch.column(text)
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).fill_null(b"")
        return {**{c: batch.column(c) for c in extra}, "fp": fingerprints(col.to_pylist()).view(np.int64)}

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return map_text(columns(docs, *extra, text), fn, f"{kinds}, fp long", text)


def named(each: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``each(doc_id, fp)`` with the component's name, from ``distinct(fp, least)`` and links ``(a, b)`` of fingerprints."""
    stars = components(found)
    rooted = distinct.join(stars, distinct.fp == stars.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.where("fp != root").select("fp", "root").join(named, "root").select("fp", "component_id")
    by_fp = by_fp.unionByName(named.select(F.col("root").alias("fp"), "component_id"))
    # Fingerprints of very many rows (texts without words, boilerplate) are few, at most one for every HOT rows: their names go to the rows.
    hot = each.groupBy("fp").count().where(F.col("count") > HOT).select("fp")
    if hot.isEmpty():
        joined = each.join(by_fp, "fp")
    else:
        few = F.broadcast(written(hot, "hot"))
        theirs = F.broadcast(by_fp.join(few, "fp", "left_semi"))
        joined = each.join(theirs, "fp").unionByName(each.join(few, "fp", "left_anti").join(by_fp, "fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    component_id: the smallest doc_id that links of at most ``radius`` bits
    reach. Null and wordless texts have fingerprint zero and link like others;
    a null doc_id gets its row and never names a component unless nothing else
    does (then null); repeated rows come back repeated.
    """
    each = written(fingerprint_column(docs), "fp")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return named(each, distinct, links(distinct, radius, most))


def survivors(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one whose doc_id names it.

    A null doc_id is its own document and stays. Rows that share a doc_id are
    one document: of several that would stay, the least row does.
    """
    found = found.select("doc_id", "component_id")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    key = unused(docs, "_id")  # so that no other column clashes
    stay = docs.join(gone.withColumnRenamed("doc_id", key), docs["doc_id"] == F.col(key), "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    if again.isEmpty():
        return stay
    repeated = stay.join(again, stay["doc_id"] == F.col(key), "left_semi")
    least = repeated.groupBy("doc_id").agg(F.min(F.struct(*[repeated[f"`{c}`"] for c in docs.columns])).alias(key)).select(f"{key}.*")
    return stay.join(again, stay["doc_id"] == F.col(key), "left_anti").unionByName(least)


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component of fingerprints."""
    return survivors(docs, near_duplicates(docs, radius))
