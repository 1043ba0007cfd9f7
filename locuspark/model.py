"""Variants as a DataFrame with a little metadata.

One row a variant, columns ``variant_index, chrom, pos, rlen, id, ref, alts,
qual, filters``, one top-level column for each INFO field (``info_X``) and each
FORMAT field (``fmt_X``, an array with one element a sample), and ``gt``
(``array<array<tinyint>>``) with ``phased``. Missing is NULL; a padding slot
does not exist, so vectors are as long as their data. A field's declared width
lives in its metadata.

For cohorts of many samples call columns can be cut into blocks of samples
(``gt__0``, ``gt__1``, ...): a few samples then read a few blocks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuspark.functions.binding import let, numbers

#: Rows of a table of variant indexes up to which it is broadcast.
BROADCAST = 1_000_000
#: Fixed columns by their name in expressions and formats.
FIXED = {"POS": "pos", "ID": "id", "QUAL": "qual", "CHROM": "chrom", "FILTER": "filters", "REF": "ref", "ALT": "alts"}


@dataclass(frozen=True)
class Field:
    """An INFO or FORMAT field. number: 0, 1, A, R, G or a width; width: slots of the declared vector."""

    category: str
    key: str
    number: str = "1"
    type: str = "Integer"
    width: int = 1
    description: str | None = None

    @property
    def column(self) -> str:
        return ("info_" if self.category == "INFO" else "fmt_") + self.key

    @property
    def vector(self) -> bool:
        return self.number not in ("0", "1")


class Scan(Protocol):
    """A source that reads the columns and the chunks of variants it is asked for."""

    def frame(self, columns: frozenset[str] | None, chunks: frozenset[int] | None) -> DataFrame: ...

    def chunks_of(self, intervals: list, by_start: bool) -> frozenset[int] | None: ...

    def chunks_between(self, first: int, last: int | None) -> frozenset[int]: ...


@dataclass(frozen=True)
class VariantSet:
    """Immutable: every ``with_`` method returns another one."""

    df: DataFrame
    samples: tuple[str, ...]
    contigs: tuple[str, ...]
    filters: tuple[str, ...] = ("PASS",)
    fields: tuple[Field, ...] = ()
    contig_lengths: tuple[int, ...] | None = None
    filter_descriptions: tuple[str, ...] | None = None
    source: str | None = None
    meta: tuple[tuple[str, str], ...] = ()
    max_alleles: int = 2
    max_rlen: int = 1 << 30
    ploidy: int = 2
    #: Samples of a block of the call columns; None: each column has all of them.
    block: int | None = None
    #: Positions of the selected samples in the cohort, in order; None: all.
    chosen: tuple[int, ...] | None = None
    #: (text or callable, is exclusion) of each filter, joined by AND.
    conditions: tuple[tuple[str | Callable, bool], ...] = ()
    #: native: computed fields follow a subset; bcftools: stored ones win in filters.
    mode: str = "native"
    #: Sample filters see the whole cohort, and the subset is taken afterwards.
    view: bool = False
    forced: frozenset[str] = field(default_factory=frozenset)
    #: How rows are read where the source cannot prune by itself, what was done to them since, and the chunks left.
    scan: Scan | None = None
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    chunks: frozenset[int] | None = None
    #: Names that the steps look at.
    used: frozenset[str] = field(default_factory=frozenset)

    # --- metadata ---------------------------------------------------------------
    @property
    def sample_ids(self) -> tuple[str, ...]:
        return self.samples if self.chosen is None else tuple(self.samples[i] for i in self.chosen)

    @property
    def has_genotypes(self) -> bool:
        return self.has("gt")

    @property
    def num_samples(self) -> int:
        return len(self.sample_ids)

    def has(self, name: str) -> bool:
        """Whether there is a call column of this name, whole or in blocks."""
        return name in self.df.columns if self.block is None else any(c.startswith(f"{name}__") for c in self.df.columns)

    def kind(self, name: str) -> T.DataType:
        """The type of a stored column, whole or in blocks."""
        return self.df.schema[name if name in self.df.columns else next(c for c in self.df.columns if c.startswith(f"{name}__"))].dataType

    @property
    def subset(self) -> bool:
        """A non-empty selection that differs from the cohort, in its order too."""
        return bool(self.chosen) and self.chosen != tuple(range(len(self.samples)))

    def stored(self, category: str, key: str) -> Field | None:
        return next((f for f in self.fields if f.category == category and f.key == key), None)

    def num_variants(self) -> int:
        return self.reading([]).df.count()

    # --- reading ----------------------------------------------------------------
    def _then(self, step: Callable[[DataFrame], DataFrame], chunks: frozenset[int] | None = None, used: Iterable[str] = (), **more) -> VariantSet:
        """The rows after one more step; ``chunks``: those that can still hold any."""
        if self.scan is None:
            return replace(self, df=step(self.df), **more)
        kept = self.chunks if chunks is None or self.chunks is None else chunks & self.chunks
        kept = chunks if self.chunks is None else kept
        out = replace(self, steps=(*self.steps, step), chunks=kept, used=self.used | set(used), **more)
        return replace(out, df=out._read(None))

    def _read(self, columns: frozenset[str] | None) -> DataFrame:
        df = self.scan.frame(columns, self.chunks)
        for step in self.steps:
            df = step(df)
        return df

    def reading(self, names: Iterable[str] | None) -> VariantSet:
        """The same set over a source that reads only what ``names`` (``POS``, ``INFO/X``, ``GT``; None: all) and the filters need.

        Parquet prunes by itself; sources that do not are asked for columns and blocks of samples.
        """
        from locuspark.functions.derived import VIRTUAL
        from locuspark.plans import expression as X

        if self.scan is None:
            return self
        wanted = {c for c in self.df.columns if "__" not in c or self.block is None}
        wanted |= {c.rpartition("__")[0] for c in self.df.columns if self.block is not None and "__" in c}
        keys = None if names is None else set(names) | self.used
        for given, _ in self.conditions:
            found = X.names(X.parse(given)) if isinstance(given, str) else getattr(given, "referenced_fields", None)
            keys = None if keys is None or found is None else keys | set(found)
        if keys is not None:
            need = {"variant_index", "chrom", "pos", "rlen"}
            for name in keys:
                prefix, _, key = name.rpartition("/")
                if not prefix and key in FIXED:
                    need.add(FIXED[key])
                if not prefix and key in ("TYPE", "ALT"):
                    need |= {"ref", "alts"}
                need |= {f.column for f in self.fields if f.key == key and prefix in ("", f.category, {"FORMAT": "FMT"}.get(f.category))}
                if key in VIRTUAL:
                    need |= {"alts", "gt"} if VIRTUAL[key][2] else {"alts"}
                if key == "GT":
                    need |= {"gt", "phased"}
            wanted &= need
        if self.block is not None:
            narrow = self.chosen is not None and not (self.view and self.conditions)
            blocks = sorted({i // self.block for i in self.chosen}) or [0] if narrow else range(-(-len(self.samples) // self.block))
            calls = {c.rpartition("__")[0] for c in self.df.columns if "__" in c}
            wanted = {c for c in wanted if c not in calls} | {f"{c}__{k}" for c in wanted & calls for k in blocks}
        return replace(self, df=self._read(frozenset(wanted)))

    # --- selection --------------------------------------------------------------
    def with_samples(self, names: Sequence[str], complement: bool = False, ignore_missing: bool = False) -> VariantSet:
        from locuspark.operators.samples import chosen

        if self.chosen is not None:
            raise RuntimeError("samples have been selected already")
        return replace(self, chosen=chosen(self.samples, names, complement, ignore_missing))

    def with_sample_indexes(self, indexes: Sequence[int]) -> VariantSet:
        from locuspark.operators.samples import checked

        if self.chosen is not None:
            raise RuntimeError("samples have been selected already")
        return replace(self, chosen=checked(indexes, len(self.samples)))

    def with_regions(self, regions) -> VariantSet:
        from locuspark.operators import regions as R

        found = R.intervals(regions, self.contigs)
        return self._then(lambda df: R.overlapping(df, found, self.max_rlen), self.scan and self.scan.chunks_of(found, False))

    def with_targets(self, targets, complement: bool = False) -> VariantSet:
        from locuspark.operators import regions as R

        found = R.intervals(targets, self.contigs)
        return self._then(lambda df: R.matching(df, found, complement), None if complement else self.scan and self.scan.chunks_of(found, True))

    def with_variants(self, indexes: Sequence[int] | DataFrame) -> VariantSet:
        """Only these variant_index values: a list becomes a literal or a table, and a table of up to ``BROADCAST`` rows is broadcast.

        Either way the bounds of the values prune the scan; only longer tables shuffle the variants.
        """
        index = F.col("variant_index")
        if not isinstance(indexes, DataFrame):
            values = sorted(set(indexes))
            if len(values) <= 100:
                return self._then(lambda df: df.where(index.isin(values)), self.scan and frozenset().union(*(self.scan.chunks_between(v, v) for v in values)))
            indexes = self.df.sparkSession.createDataFrame([(v,) for v in values], "variant_index long")
        table = indexes.select(index.cast("long").alias("variant_index"))
        n, low, high = table.agg(F.count("*"), F.min(index), F.max(index)).first()
        inside = index.between(low, high) if n else F.lit(False)
        own = F.broadcast(table) if n <= BROADCAST else table
        return self._then(lambda df: df.where(inside).join(own, "variant_index", "left_semi"), self.scan and (self.scan.chunks_between(low, high) if n else frozenset()))

    def with_frame(self, df: DataFrame) -> VariantSet:
        """The same metadata over other rows."""
        return replace(self, df=df, scan=None)

    def starting_at(self, index: int) -> VariantSet:
        if index < 0:
            raise ValueError("start must not be negative")
        return self._then(lambda df: df.where(F.col("variant_index") >= index), self.scan and self.scan.chunks_between(index, None))

    def with_filter(self, include: str | Callable | None = None, exclude: str | None = None) -> VariantSet:
        if include is not None and exclude is not None:
            raise ValueError("Cannot handle both an include expression and an exclude expression")
        if include is None and exclude is None:
            return self
        return replace(self, conditions=(*self.conditions, (exclude, True) if include is None else (include, False)))

    def with_mode(self, mode: str, view: bool = False, forced: Sequence[str] = ()) -> VariantSet:
        if mode not in ("native", "bcftools"):
            raise ValueError(f"unknown mode {mode}")
        return replace(self, mode=mode, view=view, forced=frozenset(forced))

    def materialised(self) -> VariantSet:
        """The filter as a narrow condition of the rows, which later steps take for granted; nothing is joined or kept."""
        from locuspark.plans import expression as X
        from locuspark.plans.resolve import mask

        if not self.conditions:
            return self
        found = mask(self)
        if found.shape == "G":
            raise ValueError("a filter over samples cannot be materialised")
        used = [X.names(X.parse(g)) if isinstance(g, str) else getattr(g, "referenced_fields", None) for g, _ in self.conditions]
        if self.scan is None or None in used:
            return replace(self, conditions=(), df=self.df.where(found.col), scan=None)
        return self._then(lambda df: df.where(found.col), None, frozenset().union(*used), conditions=())

    # --- columns ----------------------------------------------------------------
    def call(self, name: str, whole_cohort: bool = False) -> Column:
        """A call column for the selected samples, in their order."""
        n = len(self.samples)
        chosen = tuple(range(n)) if self.chosen is None or whole_cohort else self.chosen
        everyone = chosen == tuple(range(n))
        if self.block is None:
            if everyone:
                return F.col(name)
            if not chosen:
                return F.slice(F.col(name), 1, 0)
            return F.transform(numbers(chosen), lambda i: F.get(F.col(name), i))
        if everyone:
            return F.concat(*[F.col(f"{name}__{k}") for k in range(-(-n // self.block))])
        used = sorted({i // self.block for i in chosen}) or [0]
        # The blocks in use side by side, each as long as a full one.
        place = {b: k * self.block for k, b in enumerate(used)}
        wide = F.concat(*[F.col(f"{name}__{b}") for b in used])
        return let(wide, lambda own: F.transform(numbers([place[i // self.block] + i % self.block for i in chosen]), lambda i: F.get(own, i)))

    # --- results ----------------------------------------------------------------
    def result(self) -> DataFrame:
        from locuspark.plans.resolve import result

        return result(self).df

    def rows(self):
        """Rows in variant order, one at a time."""
        return self.result().orderBy("variant_index").toLocalIterator()
