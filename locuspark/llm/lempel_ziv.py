"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed greedily into dictionary phrases (each the shortest string
not yet in the dictionary, which it joins). The hashes of the phrase set go
into ``BINS`` bins of a one-permutation minimum hash; a fingerprint keeps one
byte of each bin's least hash, 255 for a bin without a phrase. Texts that would
compress well together share phrases, so the share of equal bins estimates the
Jaccard likeness of their phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from locuspark.llm.frames import columns, map_text, partitions, slices

BINS = 128
EMPTY = 255


def phrases(text: str, known: set[str] | None = None) -> set[str]:
    """The phrases of ``text``, added to ``known``; a last unfinished one counts as none."""
    known = set() if known is None else known
    add = known.add
    w = ""
    for c in text:
        w += c
        if w not in known:
            add(w)
            w = ""
    return known


def parsed(text: str, keep: int, tail: str) -> tuple[set[str], set[str]]:
    """Phrases of ``text`` and of ``text[:keep] + tail``; their common part is parsed once."""
    known: set[str] = set()
    add = known.add
    w = ""
    for c in text[:keep]:
        w += c
        if w not in known:
            add(w)
            w = ""
    if keep == len(text) and not tail:
        return known, known
    other = known.copy()
    return phrases_from(w, text[keep:], known), phrases_from(w, tail, other)


def phrases_from(w: str, text: str, known: set[str]) -> set[str]:
    add = known.add
    for c in text:
        w += c
        if w not in known:
            add(w)
            w = ""
    return known


def signatures(sets: list[set[str]], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` bytes for each phrase set."""
    from zlib import crc32

    size = [len(s) for s in sets]
    total = sum(size)
    h = np.empty(total, np.uint64)
    at = 0
    for s, n in zip(sets, size, strict=True):
        h[at : at + n] = np.fromiter(map(crc32, map(str.encode, s)), np.uint64, n)
        at += n
    with np.errstate(over="ignore"):
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    key = np.repeat(np.arange(len(sets)), size) * bins + (h >> np.uint64(40)).astype(np.int64) % bins
    value = h & np.uint64(0xFFFFFFFFFF)
    both = np.sort((key.astype(np.uint64) << np.uint64(40)) | value)
    key = (both >> np.uint64(40)).astype(np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    out = np.full(len(sets) * bins, EMPTY, np.uint8)
    out[key[first]] = ((both[first] & np.uint64(0xFFFFFFFFFF)) % np.uint64(255)).astype(np.uint8)
    return out.reshape(len(sets), bins)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness row by row: 1 for two empty fingerprints, chance agreement taken off."""
    full_a, full_b = a != EMPTY, b != EMPTY
    both, either = (full_a & full_b).sum(axis=-1), (full_a | full_b).sum(axis=-1)
    same = ((a == b) & full_a & full_b).sum(axis=-1)
    true = np.maximum(0.0, same - (both - same) / 254)
    return np.where(either == 0, 1.0, true / np.maximum(either, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` to ``doc_id, fingerprint`` (hex); null counts as empty."""
    def fn(batch: pa.RecordBatch) -> dict:
        sig = signatures([phrases(t or "") for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "fingerprint": [r.tobytes().hex() for r in sig]}

    return map_text(columns(docs, "doc_id", "text"), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, block, ahead``: blocks of falling doc_id, each ended by the row that follows it.

    Block bounds come from quantiles of the ids, so blocks are even whatever
    the ids are; only one row of each block is known to the driver. Nulls come
    last, and ties go by text; after the last row comes the first.
    """
    spark = docs.sparkSession
    own = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    n = max(2, 4 * partitions(spark))
    cuts = sorted({int(q) for q in own.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}, reverse=True)
    # A row's block is the number of cuts that are above its id; null ids are a block of their own.
    block = F.when(F.col("doc_id").isNull(), len(cuts) + 1)
    if cuts:
        block = block.otherwise(F.lit(len(cuts)) - F.expr(f"aggregate(array({','.join(f'{c}L' for c in cuts)}), 0, (a, c) -> a + int(doc_id >= c))"))
    else:
        block = block.otherwise(0)
    rows = own.withColumn("block", block)
    first = rows.select("doc_id", "block").groupBy("block").agg(F.max("doc_id").alias("top")).orderBy("block").collect()  # one row a block
    if not first:
        return rows.withColumn("ahead", F.lit(False))
    after = [(r["block"], r["top"], first[k - 1]["block"]) for k, r in enumerate(first)]  # before the first comes the last
    heads = spark.createDataFrame(after, f"block int, top {docs.schema['doc_id'].dataType.simpleString()}, before int").withColumnRenamed("block", "of")
    kept = F.struct(F.col("block").alias("b"), F.lit(False).alias("ahead"))
    sent = F.struct(F.col("before").alias("b"), F.lit(True).alias("ahead"))
    both = rows.join(F.broadcast(heads), (F.col("block") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")), "left")
    out = both.select("doc_id", "text", F.inline(F.when(F.col("before").isNull(), F.array(kept)).otherwise(F.array(kept, sent))))
    return out.withColumnRenamed("b", "block")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row and of its edited text, in falling order of doc_id.

    The edited text ends in the start of the next document instead of its own
    last third. doc_id is an integer; rows of one doc_id are one run of a task,
    which streams them. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. Null texts are empty, null
    ids come last, equal ids go by text, a single row is its own next; repeated
    rows come back repeated; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer, not {kind.simpleString()}")
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(doc_id: list, text: list[str], ahead: list[bool]) -> pa.RecordBatch:
        """All rows but the last, which only follows."""
        sets, new = [], []
        for k in range(len(text) - 1):
            own = text[k]
            n = len(own)
            tail = text[k + 1][: n // 3]
            new.append(own[: n - n // 3] + tail)
            sets += parsed(own, n - n // 3, tail) if not ahead[k] else (phrases(own), set())
        sig = signatures([*sets, phrases(text[-1])])
        own, edited, nxt = sig[0:-1:2], sig[1::2], sig[2::2]
        rows = [k for k in range(len(new)) if not ahead[k]]
        out = [
            pa.array([doc_id[k] for k in rows], type=to_arrow_type(kind)), pa.array([len(text[k]) for k in rows], pa.int64()), pa.array([hashlib.sha256(new[k].encode()).hexdigest() for k in rows], pa.string()),
            pa.array([own[k].tobytes().hex() for k in rows], pa.string()), pa.array([edited[k].tobytes().hex() for k in rows], pa.string()), pa.array(likeness(own, edited)[rows], pa.float64()), pa.array(likeness(own, nxt)[rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in slices(it):
            got = [h + batch.column(c).to_pylist() for h, c in zip(held, ("doc_id", "text", "ahead"), strict=True)]
            if len(got[0]) > 1:
                yield compare(*got)
            held = tuple(g[-1:] for g in got)

    n = partitions(docs.sparkSession)
    order = [F.col("block"), F.col("ahead"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return in_order(docs).repartition(n, "block").sortWithinPartitions(*order).mapInArrow(run, schema)
