"""Variants stored as chunked arrays (``variant_*``, ``call_*``), as a data source and a variant set.

A task reads one run of variant chunks, of the columns that the query needs and
of the blocks of samples that it chose; regions leave out chunks by the store's
region index, and selections of variants those by their number. Where samples
lie in several chunks, call columns are blocks of that many samples.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from locuspark.functions.sentinels import is_fill, is_missing
from locuspark.model import Field, VariantSet
from locuspark.sources.chunks import ChunkedArray, Files, arrays

_RESERVED = ("contig", "position", "length", "allele", "id", "id_mask", "quality", "filter")
_NUMBERS = {"alt_alleles": "A", "alleles": "R", "genotypes": "G"}
_SPARK = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType(), "b1": T.BooleanType()}


def _kind(a: ChunkedArray) -> T.DataType:
    return T.StringType() if a.strings or a.dtype.kind in "USO" else _SPARK[a.dtype.str[1:]]


def _described(name: str, a: ChunkedArray) -> Field:
    call = name.startswith("call_")
    key = name.partition("_")[2]
    kind = _kind(a)
    one = "Float" if isinstance(kind, (T.FloatType, T.DoubleType)) else "String" if isinstance(kind, T.StringType) else "Flag" if isinstance(kind, T.BooleanType) and not call else "Integer"
    if a.dtype.str[1:] in ("S1", "U1"):
        one = "Character"
    depth = 1 + call
    if len(a.shape) > depth + 1:
        raise ValueError(f"{name} has {len(a.shape)} axes")
    if len(a.shape) == depth:
        number, width = ("0" if one == "Flag" else "1"), 1
    else:
        width, last = a.shape[depth], a.dims[depth]
        number = _NUMBERS.get(last)
        if number is None:
            if last != f"{'FORMAT' if call else 'INFO'}_{key}_dim":
                raise ValueError(f"cannot tell how many values {name} has from its axis {last!r}")
            number = str(width)
    return Field("FORMAT" if call else "INFO", key, number, one, width, a.attrs.get("description"))


class Store:
    """A store's arrays and static values."""

    def __init__(self, path: str, backend: str | None = None, options: dict | None = None, fields: Sequence[str] | None = None):
        self.files = Files(path, backend, options)
        found, self.attrs = arrays(self.files)
        static = lambda n: found[n].whole(self.files) if n in found else None
        text = lambda v: None if v is None else tuple(str(x) for x in v.tolist())
        ids = text(static("sample_id")) or ()
        self.real = [i for i, s in enumerate(ids) if s]  # a sample without a name does not exist
        self.samples = tuple(ids[i] for i in self.real)
        self.contigs, self.filters = text(static("contig_id")) or (), text(static("filter_id")) or ("PASS",)
        self.texts, lengths = text(static("filter_description")), static("contig_length")
        self.lengths = None if lengths is None else tuple(int(x) for x in lengths)
        self._index = found.get("region_index")
        axis = {n: a for n, a in found.items() if a.dims[:1] == ("variants",) and not n.endswith(("_mask", "_fill"))}
        if not axis:
            raise ValueError("no array has a variants axis")
        calls = {n: a.chunks[0] for n, a in axis.items() if n.startswith("call_")}
        if len(set(calls.values())) > 1:
            raise ValueError(f"call arrays must share one variants chunk size: {calls}")
        self.step = next(iter(calls.values())) if calls else math.gcd(*(a.chunks[0] for a in axis.values()))
        if bad := [n for n, a in axis.items() if a.chunks[0] % self.step]:
            raise ValueError(f"the variants chunk size of {bad[0]} is not a multiple of {self.step}")
        self.fields = {n: _described(n, a) for n, a in axis.items() if n.startswith(("variant_", "call_")) and n.partition("_")[2] not in _RESERVED and n not in ("call_genotype", "call_genotype_phased")}
        if fields is not None:
            wanted = set(fields)
            self.fields = {n: f for n, f in self.fields.items() if f.column in wanted or n in wanted or f"{f.category}/{f.key}" in wanted}
            axis = {n: a for n, a in axis.items() if n in self.fields or n.partition("_")[2] in _RESERVED or (n in ("call_genotype", "call_genotype_phased") and "GT" in wanted)}
        self.arrays = axis
        self.rows = next(iter(axis.values())).shape[0]
        self.span = max(a.chunks[0] for a in axis.values())
        wide = {a.chunks[1] for n, a in axis.items() if n.startswith("call_")}
        #: Samples of a block, if call columns are cut into blocks.
        self.block = next(iter(wide)) if len(wide) == 1 and min(wide) < len(ids) and len(self.real) == len(ids) else None

    @cached_property
    def region_index(self) -> np.ndarray | None:
        """Rows of chunk, contig, first and last position, last end, and records."""
        own = None if self._index is None else self._index.whole(self.files)
        return own if own is not None and own.ndim == 2 and own.shape[1] >= 6 and own.any() else None

    def schema(self) -> T.StructType:
        text, many = T.StringType(), T.ArrayType
        out = [("variant_index", T.LongType()), ("chrom", text), ("pos", T.LongType()), ("rlen", T.IntegerType()), ("id", text), ("ref", text), ("alts", many(text)), ("qual", T.FloatType()), ("filters", many(text))]
        for n, f in self.fields.items():
            kind = _kind(self.arrays[n])
            kind = many(kind) if f.vector else kind
            out += [(c, many(kind)) for c in self.blocks(f.column)] if f.category == "FORMAT" else [(f.column, kind)]
        for n, column, kind in (("call_genotype", "gt", many(T.ByteType())), ("call_genotype_phased", "phased", T.BooleanType())):
            if n in self.arrays:
                out += [(c, many(kind)) for c in self.blocks(column)]
        return T.StructType([T.StructField(*x) for x in out])

    def blocks(self, column: str) -> list[str]:
        """The columns that a call column is cut into."""
        return [column] if self.block is None else [f"{column}__{k}" for k in range(-(-len(self.samples) // self.block))]

    def batch(self, a: int, b: int, columns: frozenset[str] | None = None) -> pa.RecordBatch:
        """Rows ``a`` to ``b`` in the model's columns, or in those of them that are wanted."""
        n = b - a
        schema = self.schema()
        want = to_arrow_schema(T.StructType([f for f in schema if columns is None or f.name in columns]))
        held: dict[str, np.ndarray] = {}

        def get(name: str, block: int | None = None) -> np.ndarray | None:
            if name not in self.arrays:
                return None
            if (name, block) not in held:
                held[name, block] = self.arrays[name].rows(self.files, a, b, block)
            return held[name, block]

        site = {
            "variant_index": lambda: np.arange(a, b), "chrom": lambda: pa.array(self.contigs).take(pa.array(get("variant_contig").astype(np.int64))), "pos": lambda: get("variant_position").astype(np.int64), "rlen": lambda: self._lengths(get), "id": lambda: self._known(get("variant_id"), n, pa.string()),
            "ref": lambda: pa.array(get("variant_allele")[:, 0].tolist(), pa.string()), "alts": lambda: _lists(get("variant_allele")[:, 1:]), "qual": lambda: self._known(_single(get("variant_quality")), n, pa.float32()), "filters": lambda: self._filters(get("variant_filter"), n),
        }
        info = {f.column: (name, f) for name, f in self.fields.items() if f.category == "INFO"}
        calls = {f.column: (name, f.vector) for name, f in self.fields.items() if f.category == "FORMAT"} | {"gt": ("call_genotype", True), "phased": ("call_genotype_phased", False)}

        def made(column: str):
            if column in site:
                return site[column]()
            if column in info:
                name, f = info[column]
                return _lists(get(name)) if f.vector else _flat(get(name))
            own, block = column, None
            if self.block is not None:
                own, _, k = column.rpartition("__")
                block = int(k)
            name, vector = calls[own]
            values = get(name, block)
            values = values if block is not None else values[:, self.real]
            flat = _lists(values.reshape(-1, values.shape[2])) if vector else _flat(values.reshape(-1))
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), flat)

        return pa.RecordBatch.from_arrays([_cast(made(c.name), c.type) for c in want], schema=want)

    def _lengths(self, get) -> np.ndarray:
        own = get("variant_length")
        return np.array([len(x) for x in get("variant_allele")[:, 0]]) if own is None else own

    def _filters(self, marks: np.ndarray | None, n: int) -> pa.Array:
        return pa.array([["PASS"]] * n if marks is None else [[f for f, m in zip(self.filters, row, strict=True) if m] for row in marks], pa.list_(pa.string()))

    @staticmethod
    def _known(values: np.ndarray | None, n: int, kind: pa.DataType) -> pa.Array:
        return pa.nulls(n, kind) if values is None else _flat(values)

    # --- pruning --------------------------------------------------------------------
    @property
    def count(self) -> int:
        """Chunks of variants."""
        return -(-self.rows // self.step)

    def chunks_of(self, intervals: list, by_start: bool) -> frozenset[int] | None:
        """Chunks that can hold a variant of any interval, by its bases or by its first one only; None: no index tells."""
        index = self.region_index
        if index is None:
            return None
        out: set[int] = set()
        for contig, a, b in intervals:
            last = index[:, 3 if by_start else 4]
            hit = (index[:, 1] == self.contigs.index(contig)) & (last >= (a or 0)) & (index[:, 2] <= (np.iinfo(np.int64).max if b is None else b))
            out |= set(index[hit, 0].tolist())
        return frozenset(out)

    def chunks_between(self, first: int, last: int | None) -> frozenset[int]:
        return frozenset(range(first // self.step, self.count if last is None else min(self.count, last // self.step + 1)))


def _single(values: np.ndarray | None) -> np.ndarray | None:
    """Quality as single precision, whose missing value has bits of its own."""
    return values if values is None or values.dtype.itemsize == 4 or is_missing(values).any() else values.astype(np.float32)


def _cast(values, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return values if values.type == kind else values.cast(kind)


def _native(values: np.ndarray) -> np.ndarray:
    values = values.astype(values.dtype.newbyteorder("="), copy=False)
    return values.astype(np.float32) if values.dtype == np.float16 else values


def _flat(values: np.ndarray) -> pa.Array:
    """One-dimensional values, NULL where missing or padding; a flag is never missing."""
    if values.dtype.kind == "b":
        return pa.array(values)
    if values.dtype.kind == "S":
        values = np.char.decode(values, "utf-8")
    none = is_missing(values) | is_fill(values)
    if values.dtype.kind in "OU":
        return pa.array([None if m else str(v) for v, m in zip(values.tolist(), none, strict=True)], pa.string())
    return pa.array(_native(values), mask=none)


def _lists(values: np.ndarray) -> pa.Array:
    """Two-dimensional values as lists without the padding at their ends."""
    if values.dtype.kind == "S":
        values = np.char.decode(values, "utf-8")
    rows, width = values.shape
    if values.dtype.kind == "b":
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.reshape(-1)))
    real = ~is_fill(values)
    size = np.where(real.any(axis=1), width - real[:, ::-1].argmax(axis=1), 0) if width else np.zeros(rows, int)
    keep = np.arange(width)[None, :] < size[:, None]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), _flat(values[keep]))


class _Reader(DataSourceReader):
    def __init__(self, store: Store, columns: frozenset[str] | None, chunks: frozenset[int] | None):
        self.store, self.columns, self.chunks = store, columns, chunks

    def partitions(self) -> list[InputPartition]:
        """Runs of the chunks that are left, as many as the largest chunk of any array spans."""
        runs: dict[int, list[int]] = {}
        for k in range(self.store.count) if self.chunks is None else sorted(self.chunks):
            runs.setdefault(k * self.store.step // self.store.span, []).append(k)
        return [InputPartition(tuple(own)) for own in runs.values()] or [InputPartition(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for k in partition.value:
            a = k * self.store.step
            yield self.store.batch(a, min(a + self.store.step, self.store.rows), self.columns)


class VcfZarrDataSource(DataSource):
    """``spark.read.format("vcfzarr").load(path)``; options ``backend``, ``fields`` and ``columns`` (comma lists) and ``chunks`` (a JSON list of [first, past])."""

    @classmethod
    def name(cls) -> str:
        return "vcfzarr"

    def _given(self) -> tuple[Store, frozenset[str] | None, frozenset[int] | None]:
        options = dict(self.options)
        fields, columns, chunks = (options.pop(k, None) for k in ("fields", "columns", "chunks"))
        store = Store(options.pop("path"), options.pop("backend", None), options, None if fields is None else fields.split(","))
        ranges = None if chunks is None else json.loads(chunks)
        return store, None if columns is None else frozenset(columns.split(",")), None if ranges is None else frozenset(k for a, b in ranges for k in range(a, b))

    def schema(self) -> T.StructType:
        store, columns, _ = self._given()
        return T.StructType([f for f in store.schema() if columns is None or f.name in columns])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(*self._given())


class StoreScan:
    """Reads of one store; what is asked for goes along as options."""

    def __init__(self, spark: SparkSession, store: Store, path: str, backend: str | None, options: dict | None, fields: Sequence[str] | None):
        self.spark, self.store, self.path = spark, store, str(path)
        self.options = {k: str(v) for k, v in (options or {}).items()} | ({"backend": backend} if backend else {}) | ({"fields": ",".join(fields)} if fields is not None else {})

    def frame(self, columns: frozenset[str] | None, chunks: frozenset[int] | None):
        own = dict(self.options)
        if columns is not None:
            own["columns"] = ",".join(sorted(columns))
        if chunks is not None:
            own["chunks"] = json.dumps(_ranges(chunks))
        return self.spark.read.format("vcfzarr").options(**own).load(self.path)

    def chunks_of(self, intervals: list, by_start: bool) -> frozenset[int] | None:
        return self.store.chunks_of(intervals, by_start)

    def chunks_between(self, first: int, last: int | None) -> frozenset[int]:
        return self.store.chunks_between(first, last)


def _ranges(chunks: frozenset[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for k in sorted(chunks):
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return out


def read(spark: SparkSession, path: str, backend: str | None = None, options: dict | None = None, fields: Sequence[str] | None = None) -> VariantSet:
    """A store as a variant set. ``fields``: the INFO and FORMAT fields (and ``GT``) that it has; None: all. Queries read only what they use."""
    store = Store(path, backend, options, fields)
    spark.dataSource.register(VcfZarrDataSource)
    scan = StoreScan(spark, store, path, backend, options, fields)
    gt = store.arrays.get("call_genotype")
    meta = tuple((str(k), str(v)) for k, v in store.attrs.get("vcf_meta_information", ()))
    return VariantSet(
        scan.frame(None, None), store.samples, store.contigs, store.filters, tuple(store.fields.values()), store.lengths, store.texts, store.attrs.get("source"), meta,
        max_alleles=store.arrays["variant_allele"].shape[1], ploidy=2 if gt is None else gt.shape[2], block=store.block, scan=scan,
    )
