"""Near-duplicates by shingle similarity: SimHash fingerprints propose, whole shingle sets decide.

Two texts are near-duplicates if their sets of ``SHINGLE``-word shingles have a
Jaccard similarity of ``SIMILAR`` or more. Equal sets collapse first. Each set has
a SimHash, and what covering hashing (see :mod:`simhash`) connects by fingerprints
of at most ``RADIUS`` differing bits is a bucket; no pair within the radius is
missed. Bit i of the 64 has the vector 64 + i of GF(2)**7, so each of the 126
tables keeps 32 bits (for v = 64 it would keep all, which finds equal ones only).
The members of a bucket meet with their whole sets, and a search finds the
components of the bucket: every pair that is not in one component is compared, so
nothing in it is missed and no pair below the threshold is linked. Only links
leave the task, never all pairs.

At the threshold fingerprints differ in ten bits on average, for which covering
takes 2047 tables, so pairs beyond the radius go another way: ``BANDS`` keys of
``ROWS`` minimum hashes each are dealt out, and a pair at the threshold shares no
key with a probability of (1 - 0.8**5)**40 = 1.3e-7, one above it with less.
Keys with the same members count as one bucket. Those whose members are connected
already are done; the members of the others meet in the same way.

A bucket of more than ``PIECE_SIZE`` shingles is solved in pieces. All links so far
then give each member a component; the members outside the most frequent one of
their bucket meet each piece of it, in bounded batches, and what is similar is
linked. Pairs of one component need no comparison, so that again nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.components import components
from locuspark.llm.frames import columns, map_text, partitions, written
from locuspark.llm.simhash import LONG, MOST, _bits, _bucket_links, _runs, named, survivors
from locuspark.llm.tokens import mixed

SHINGLE, SIMILAR = 5, 0.8
#: Differing bits that covering hashing bridges, and its tables that are dealt at once.
RADIUS, TABLES = 6, 63
ROWS, BANDS = 5, 40
#: Shingles that are hashed ``ROWS * BANDS`` times at once, and shingles that meet in one task.
PIECE, PIECE_SIZE = 4096, 4_000_000
U = np.uint64


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the word shingles; a shorter text is one shingle, no words none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    each = map(b" ".join, zip(*(words[j:] for j in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), each), U))


def identity(own: np.ndarray) -> int:
    """A number for a whole set, as a signed long."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0], U).view(np.int64)[0])


def fingerprint(own: np.ndarray) -> int:
    """The strict majority of each bit over the set, as a signed long; the empty set: zero."""
    ones = sum((_bits(own[i : i + LONG]).sum(axis=0, dtype=np.int64) for i in range(0, len(own), LONG)), np.zeros(64, np.int64))
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def band_keys(own: np.ndarray) -> np.ndarray:
    """The key of each band."""
    rng = np.random.default_rng(5)
    flip, factor = (rng.integers(0, 1 << 32, ROWS * BANDS, dtype=U).astype(np.uint32) for _ in range(2))
    short = (own >> U(32)).astype(np.uint32)[:, None]
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(own), PIECE):
        least = np.minimum(least, ((short[i : i + PIECE] ^ flip) * (factor | np.uint32(1))).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=U)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key ^ column.astype(U))
    return key


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    col = batch.column("text")
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).fill_null(b"").to_pylist()


def _deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        keys = [np.frombuffer(k, np.int64) for k in batch.column(1).to_pylist()]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(fps, [len(k) for k in keys]))], names=["key", "fp"])


def _buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to (bucket, member) where a key has several; the bucket is named by its members."""
    for keys, fps, _ in _runs(it, 1 << 62):
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(at, len(keys)))
        several = np.repeat(size > 1, size)
        if several.any():
            with np.errstate(over="ignore"):
                name = mixed(np.add.reduceat(mixed(fps.view(U)), at)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[several]), pa.array(fps[several])], names=["bucket", "fp"])


def linked(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """For each set, the first set of its component among ``sets`` by links of at least ``similar``."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.arange(len(sets))
    at = np.cumsum(size) - size
    own = [flat[a : a + n] for a, n in zip(at, size, strict=True)]
    has = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    left, rest = np.arange(len(sets)), flat  # not reached yet
    while len(left) > 1:
        seed, queue = left[0], [left[0]]
        drop = np.zeros(len(left), bool)
        drop[0] = True
        while True:
            if drop.any():
                rest = rest[np.repeat(~drop, size[left])]
                left = left[~drop]
            if not queue or not len(left):
                break
            k = queue.pop()
            has[own[k]] = True
            shared = np.add.reduceat(has[rest], np.cumsum(size[left]) - size[left], dtype=np.int64)
            has[own[k]] = False
            drop = shared + 1e-9 >= similar * (size[k] + size[left] - shared)
            queue += left[drop].tolist()
            first[left[drop]] = seed
    return first


def crossing(left: list[np.ndarray], right: list[np.ndarray], similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``left``, place in ``right``) of at least the similarity."""
    size = np.array([len(s) for s in left])
    _, flat = np.unique(np.concatenate(left + right), return_inverse=True)
    at = np.cumsum(size) - size
    mine, begin = flat[: size.sum()], int(size.sum())
    has = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for k, own in enumerate(right):
        place = flat[begin : begin + len(own)]
        begin += len(own)
        has[place] = True
        shared = np.add.reduceat(has[mine], at, dtype=np.int64)
        has[place] = False
        hit = np.flatnonzero(shared + 1e-9 >= similar * (len(own) + size - shared))
        a.append(hit)
        b.append(np.full(len(hit), k))
    return np.concatenate(a), np.concatenate(b)


def _grouped(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows sorted by their first ``keys`` columns, group by group."""
    now, held = None, []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now and held:
                yield held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield held


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _within(similar: float):
    """``bucket, piece, fp, own`` to links that connect what is similar in each piece."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(it, 2):
            fps = np.array([fp for fp, _ in rows], np.int64)
            first = linked([np.frombuffer(s, U) for _, s in rows], similar)
            more = np.flatnonzero(first != np.arange(len(first)))
            if len(more):
                yield _links(fps[first[more]], fps[more])

    return run


def _across(similar: float):
    """``bucket, piece, part, fp, stray, own`` to links between strays and the others of each piece."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(it, 3):
            left, right = ([(fp, np.frombuffer(s, U)) for fp, stray, s in rows if stray == k] for k in (False, True))
            if left and right:
                a, b = crossing([s for _, s in left], [s for _, s in right], similar)
                ends = np.array([left[k][0] for k in a], np.int64), np.array([right[k][0] for k in b], np.int64)
                if (ends[0] != ends[1]).any():
                    yield _links(*ends)

    return run


def _between_pieces(hot: DataFrame, sets: DataFrame, found: DataFrame, most: int, similar: float) -> DataFrame:
    """Links that the pieces of ``hot(bucket, fp, n, pieces, piece)`` could not see, given those ``found``."""
    parts = partitions(hot.sparkSession)
    stars = components(found)
    own = written(hot.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    main = own.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    own = own.join(main, "bucket")
    strays = own.where("root != main")
    batches = strays.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / most)).cast("int").alias("batches"))
    strays = strays.join(batches, "bucket").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(3)), "batches").cast("int"))
    strays = strays.select("bucket", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "part", "fp", F.lit(True).alias("stray"))
    others = own.join(batches, "bucket").select("bucket", "piece", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("part"), "fp", F.lit(False).alias("stray"))
    met = others.unionByName(strays).join(sets, "fp").select("bucket", "piece", "part", "fp", "stray", "own")
    return met.repartition(parts, "bucket", "piece", "part").sortWithinPartitions("bucket", "piece", "part", "fp").mapInArrow(_across(similar), "a long, b long")


def _met(members: DataFrame, distinct: DataFrame, sets: DataFrame, found: DataFrame | None, most: int, similar: float) -> DataFrame:
    """Links ``found`` and those that the buckets of ``members(bucket, fp)`` add, in the shared folder."""
    parts = partitions(members.sparkSession)
    sized = members.join(distinct.select("fp", "n"), "fp")
    pieces = sized.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / most)).cast("int").alias("pieces"))
    cut = sized.join(pieces, "bucket").withColumn("piece", F.pmod(F.xxhash64("fp"), "pieces").cast("int"))
    met = cut.join(sets, "fp").select("bucket", "piece", "fp", "own").repartition(parts, "bucket", "piece").sortWithinPartitions("bucket", "piece", "fp")
    more = written(met.mapInArrow(_within(similar), "a long, b long").distinct(), "links")
    found = more if found is None else found.union(more)
    if not pieces.where("pieces > 1").isEmpty():
        found = written(found.union(_between_pieces(cut.where("pieces > 1"), sets, found, most, similar)).distinct(), "links")
    return found


def masks() -> list[int]:
    """The bits that each table of covering hashing keeps, for a radius of 6."""
    return [sum(1 << i for i in range(64) if ((64 + i) & v).bit_count() % 2) for v in range(1, 128) if v != 64]


def _masked(keep: list[int]):
    """Fingerprints to ``key, sim`` for each table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sims = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for mask in keep:
                with np.errstate(over="ignore"):
                    key = mixed(mixed(sims & U(mask)) + U(mask)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sims.view(np.int64))], names=["key", "sim"])

    return run


def _connect(most: int):
    """Rows sorted by key to links that connect the fingerprints within the radius.

    A key of more than ``most`` fingerprints connects them all, in linear time:
    their bucket is larger than need be, and whole sets decide.
    """
    near = _bucket_links(RADIUS, 1 << 62)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        for keys, sims, long in _runs(it, most):
            if not len(keys):
                continue
            if long:  # one key, which may come in several parts
                if keys[0] != held:
                    held, first = keys[0], sims[0]
                yield _links(np.full(len(sims), first), sims)
                continue
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            size = np.diff(at)
            large = size > most
            for k in np.flatnonzero(large):
                yield _links(np.full(size[k], sims[at[k]]), sims[at[k] : at[k + 1]])
            rest = ~np.repeat(large, size)
            for batch in near(iter([_links(keys[rest], sims[rest])])):
                yield batch.select(["a", "b"])

    return run


def within_radius(sims: DataFrame, most: int = MOST) -> DataFrame:
    """``sims(sim)`` of different fingerprints to links that connect all pairs within the radius."""
    n, keep, out = partitions(sims.sparkSession), masks(), None
    for at in range(0, len(keep), TABLES):
        dealt = sims.mapInArrow(_masked(keep[at : at + TABLES]), "key long, sim long").repartition(n, "key").sortWithinPartitions("key", "sim")
        found = written(dealt.mapInArrow(_connect(most), "a long, b long").distinct(), "near")
        out = found if out is None else out.union(found)
    return out


def fingerprint_buckets(distinct: DataFrame) -> DataFrame:
    """``distinct(fp, sim, n)`` to ``bucket, fp``: sets that SimHashes within the radius connect, where there are several."""
    worded = distinct.where("n > 0").select("fp", "sim")
    stars = components(within_radius(worded.select("sim").distinct()))
    rooted = worded.join(stars, worded["sim"] == stars["node"], "left").select(F.coalesce("root", "sim").alias("bucket"), "fp")
    several = rooted.groupBy("bucket").count().where("count > 1").select("bucket")
    return rooted.join(several, "bucket", "left_semi").select("bucket", "fp")


def band_buckets(each: DataFrame) -> DataFrame:
    """``each(fp, keys)`` to ``bucket, fp``: sets that share a key of minimum hashes."""
    n = partitions(each.sparkSession)
    dealt = each.groupBy("fp").agg(F.first("keys").alias("keys")).select("fp", "keys").mapInArrow(_deal, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_buckets, "bucket long, fp long").distinct()


def _unconnected(members: DataFrame, found: DataFrame) -> DataFrame:
    """The buckets of ``members(bucket, fp)`` that links ``found`` do not connect as a whole."""
    rooted = members.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    still = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    return members.join(still, "bucket", "left_semi").select("bucket", "fp")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, most: int = PIECE_SIZE, bands: bool = True) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    fingerprint: a hash of the shingle set. component_id: the smallest doc_id
    that links reach. Texts without words are copies of each other; nulls and
    repeated rows are as in :func:`simhash.near_duplicates`. Without ``bands``
    only what SimHashes propose is linked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keyed(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in _bytes(batch)]
        keys = [band_keys(s).tobytes() if bands and len(s) else b"" for s in sets]
        return {"doc_id": batch.column("doc_id"), "fp": [identity(s) for s in sets], "sim": [fingerprint(s) for s in sets], "n": [len(s) for s in sets], "keys": keys}

    def whole(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in _bytes(batch)]
        return {"fp": [identity(s) for s in sets], "own": [s.tobytes() for s in sets]}

    own = columns(docs, "doc_id", "text")
    each = written(map_text(own, keyed, f"doc_id {kind}, fp long, sim long, n long, keys binary"), "keys")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("sim").alias("sim"))
    alike = written(fingerprint_buckets(distinct), "alike")
    banded = written(band_buckets(each), "buckets")
    asked = distinct.join(alike.select("fp").union(banded.select("fp")).distinct(), "fp", "left_semi").select(F.col("least").alias("asked")).distinct()
    texts = own.join(asked, own["doc_id"].eqNullSafe(asked["asked"]), "left_semi")
    sets = written(map_text(texts, whole, "fp long, own binary").groupBy("fp").agg(F.first("own").alias("own")), "sets")
    found = _met(alike, distinct, sets, None, most, similar)
    if bands:
        found = _met(written(_unconnected(banded, found), "open"), distinct, sets, found, most, similar)
    return named(each.select("doc_id", "fp"), distinct.select("fp", "least"), found.distinct())


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of ``docs`` for each component, as :func:`simhash.survivors` has it."""
    return survivors(docs, near_duplicates(docs, similar))
