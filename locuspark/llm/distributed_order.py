"""Suffix order of all texts by a distributed difference cover modulo 3, and removal by it.

At each level the triples at positions 1 and 2 modulo 3 of every string are
sorted across tasks (range partitions) and named by their rank; names become
the next level's strings, until a name stands for as many symbols as matter.
On the way back the remaining suffixes, each a symbol and the rank of its
successor, are merged in: what is less than a suffix is counted in sorted
tables of keys. In the end adjacent prefixes are compared.

Every step is a shuffle of all positions, tens of bytes for each byte of text.
:mod:`locuspark.llm.suffix_dedup` gives the same rows from a small part of the
positions; this is the plain form of the method, for corpora that fit it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.frames import columns, drop_written, partitions, written
from locuspark.llm.tokens import raw

KEYS = ("k1", "k2", "k3")


def _longs(**cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in cols.values()], names=list(cols))


def _strings(batch: pa.RecordBatch, column: str = "s") -> list[np.ndarray]:
    return [np.frombuffer(x or b"", "<i8") for x in batch.column(column).to_pylist()]


def _before(table: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """``table`` of different keys ``k1, k2, k3`` with, for each of ``counts``, the sum over all smaller keys."""
    n = partitions(table.sparkSession)
    names = (*KEYS, *counts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total = TaskContext.get().partitionId(), np.zeros(len(counts), np.int64)
        for batch in it:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            sums = []
            for k, own in enumerate(cols[3:]):
                ends = total[k] + np.cumsum(own)
                sums.append(ends - own)
                total[k] = ends[-1] if len(ends) else total[k]
            yield _longs(**dict(zip(KEYS, cols, strict=False)), **dict(zip(counts, sums, strict=True)), pid=np.full(batch.num_rows, pid), last=np.zeros(batch.num_rows))
        yield _longs(**{k: [0] for k in KEYS}, **{c: [t] for c, t in zip(counts, total.tolist(), strict=True)}, pid=[pid], last=[1])

    schema = ", ".join(f"{c} long" for c in (*names, "pid", "last"))
    ranged = table.select(*names).repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS)
    found = written(ranged.mapInArrow(run, schema), "keys")
    ends = found.where("last = 1").orderBy("pid").collect()  # a row a task
    total, rows = [0] * len(counts), []
    for r in ends:
        rows.append((r["pid"], *total))
        total = [t + r[c] for t, c in zip(total, counts, strict=True)]
    offsets = F.broadcast(table.sparkSession.createDataFrame(rows, ", ".join(["pid long", *(f"o_{c} long" for c in counts)])))
    return found.where("last = 0").join(offsets, "pid").select(*KEYS, *[(F.col(c) + F.col(f"o_{c}")).alias(c) for c in counts])


def _sample(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions 1 and 2 modulo 3; one of the first past the end, if it must part the two halves."""
    return np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)


def _triples(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for doc, s in zip(batch.column("doc").to_pylist(), _strings(batch), strict=True):
            at = np.concatenate(_sample(len(s)))
            t = np.concatenate([s, np.zeros(4, np.int64)])
            yield _longs(doc=np.full(len(at), doc), j=np.arange(len(at)), k1=t[at], k2=t[at + 1], k3=t[at + 2])


def _regrouped(rows: DataFrame) -> DataFrame:
    """``doc, j, v`` to ``doc, s``: the values of each document in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in it:
            doc, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "v"))
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
            for a, b in zip(at, np.append(at[1:], len(doc)), strict=True):
                if doc[a] != now and parts:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["doc", "s"])
                    parts = []
                now = int(doc[a])
                parts.append(v[a:b])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["doc", "s"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "doc").sortWithinPartitions("doc", "j").select("doc", "v").mapInArrow(run, "doc long, s binary")


def _suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings and sample ranks to the keys by which suffixes meet: 0 and 1 by two symbols, 0 and 2 by three, samples by rank."""
    for batch in it:
        for doc, s, r in zip(batch.column("doc").to_pylist(), _strings(batch), _strings(batch, "r"), strict=True):
            n = len(s)
            ones, twos = _sample(n)
            rank = np.zeros(n + 4, np.int64)
            rank[np.concatenate([ones, twos])] = r
            rank[n:] = 0
            t = np.concatenate([s, np.zeros(4, np.int64)])
            at = np.arange(n)
            none = np.full(n, -1)
            for what, own, keys in ((0, at % 3 != 2, (t[at], rank[at + 1], none)), (1, at % 3 != 1, (t[at], t[at + 1], rank[at + 2])), (2, at % 3 != 0, (rank[at], none, none))):
                yield _longs(doc=np.full(own.sum(), doc), i=at[own], what=np.full(own.sum(), what), k1=keys[0][own], k2=keys[1][own], k3=keys[2][own])


def ranks(strings: DataFrame, enough: int, width: int = 1) -> DataFrame:
    """``doc, s`` (the suffix rank of each position, from 1) of strings ``doc, s`` of positive longs.

    ``width``: original symbols that one value stands for. Suffixes that agree
    in ``enough`` of them and more may share a rank, and whole suffixes that are
    equal come in any order.
    """
    rows = written(strings.mapInArrow(_triples, "doc long, j long, k1 long, k2 long, k3 long"), "triples")
    names = _before(rows.select(*KEYS).distinct().withColumn("n", F.lit(1).cast("long")), ("n",))
    named = rows.join(names, list(KEYS)).select("doc", "j", (F.col("n") + 1).alias("v"))
    sample = written(_regrouped(named), "names")
    if 3 * width < enough and names.count() < rows.count():
        sample = ranks(sample, enough, 3 * width)
    both = strings.join(sample.withColumnRenamed("s", "r"), "doc", "left")
    keys = written(both.mapInArrow(_suffixes, "doc long, i long, what long, k1 long, k2 long, k3 long"), "suffixes")
    parts = []
    for what in (0, 1, 2):
        own = keys.where(F.col("what") == what)
        zero = (F.col("i") % 3 == 0).cast("long")
        table = own.groupBy(*KEYS).agg(F.sum(zero).alias("zeros"), F.sum(1 - zero).alias("others"))
        own = own.join(_before(table, ("zeros", "others")), list(KEYS))
        # A suffix of the first kind counts its own kind once, in the first table.
        counted = F.when(F.col("i") % 3 == 0, F.col("others") + (F.col("zeros") if what == 0 else 0)).otherwise(F.col("others") if what == 2 else F.col("zeros"))
        parts.append(own.select("doc", "i", counted.alias("c")))
    place = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc", "i").agg((F.sum("c") + 1).alias("v"))
    out = written(_regrouped(place.withColumnRenamed("i", "j")), "ranks")
    for table in (rows, keys):
        drop_written(table)
    return out


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of :func:`suffix_dedup.deduplicated`, from the order of all suffixes.

    doc_id is a whole number that does not repeat; nulls count as there.
    """
    n = partitions(docs.sparkSession)
    texts = columns(docs, "doc_id", "text")
    known = texts.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.encode("text", "UTF-8").alias("b"))

    def symbols(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = raw(batch.column("b"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([(data[a:b].astype(np.int64) + 1).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["doc", "s"])

    strings = written(known.mapInArrow(symbols, "doc long, s binary"), "strings")
    order = ranks(strings, length)

    def prefixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc, text, place in zip(batch.column("doc").to_pylist(), batch.column("b").to_pylist(), _strings(batch), strict=True):
                m = len(text) - length + 1
                if m > 0:
                    yield pa.RecordBatch.from_arrays([pa.array(place[:m]), pa.array(np.full(m, doc)), pa.array(np.arange(m)), pa.array([text[k : k + length] for k in range(m)], pa.binary())], names=["place", "doc", "i", "prefix"])

    def classes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adjacent prefixes that are equal are one class; its smallest document is in its first row, by order."""
        before, number = None, 0
        pid = TaskContext.get().partitionId()
        for batch in it:
            label = []
            for p in batch.column("prefix").to_pylist():
                number += p != before
                before = p
                label.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("i"), pa.array(np.full(batch.num_rows, pid, np.int64)), pa.array(label, pa.int64()), batch.column("prefix")], names=["doc", "i", "pid", "label", "prefix"])

    suffixes = known.join(order, "doc").mapInArrow(prefixes, "place long, doc long, i long, prefix binary")
    ordered = suffixes.repartitionByRange(n, "place").sortWithinPartitions("place", "doc", "i")
    rows = written(ordered.mapInArrow(classes, "doc long, i long, pid long, label long, prefix binary"), "classes")
    least = rows.groupBy("pid", "label").agg(F.min("doc").alias("least"), F.first("prefix").alias("prefix"))
    # A class that lies across partitions has its first and last labels joined.
    edge = Edges(least)
    rows = rows.select("doc", "i", "pid", "label").join(edge.least(least), ["pid", "label"]).where("doc > least")
    gone = _regrouped(rows.select("doc", F.col("i").alias("j"), F.col("i").alias("v")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text, at in zip(batch.column("b").to_pylist(), _strings(batch), strict=True):
                own = np.frombuffer(text or b"", np.uint8)
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                hit = np.cumsum(edge[:-1]) > 0
                out.append((len(own), int(hit.sum()), int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(own) else 0, hashlib.sha256(own[~hit].tobytes()).hexdigest()))
            size, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both = texts.select("doc_id", F.encode("text", "UTF-8").alias("b")).join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "b", "s")
    return both.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


class Edges:
    """First and last class of each range partition, two rows a partition, and which of them are one."""

    def __init__(self, least: DataFrame):
        ends = least.groupBy("pid").agg(F.min(F.struct("label", "prefix", "least")).alias("a"), F.max(F.struct("label", "prefix", "least")).alias("b")).orderBy("pid").collect()
        self.found: dict[tuple[int, int], int] = {}
        run: list[tuple[int, int, int]] = []
        before = None
        for r in ends:
            for e in dict.fromkeys(((r["a"]["label"], bytes(r["a"]["prefix"]), r["a"]["least"]), (r["b"]["label"], bytes(r["b"]["prefix"]), r["b"]["least"]))):
                if e[1] != before:
                    self._close(run)
                    run = []
                run.append((r["pid"], e[0], e[2]))
                before = e[1]
        self._close(run)

    def _close(self, run: list[tuple[int, int, int]]) -> None:
        if len(run) > 1:
            self.found |= {(p, k): min(x[2] for x in run) for p, k, _ in run}

    def least(self, least: DataFrame) -> DataFrame:
        """``pid, label, least`` with what the neighbours know."""
        if not self.found:
            return least.select("pid", "label", "least")
        more = least.sparkSession.createDataFrame([(p, k, v) for (p, k), v in self.found.items()], "pid long, label long, across long")
        return least.join(F.broadcast(more), ["pid", "label"], "left").select("pid", "label", F.coalesce("across", "least").alias("least"))
