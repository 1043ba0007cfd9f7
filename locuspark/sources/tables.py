"""Variant sets as Parquet: one wide table in variant order, and its metadata beside it."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.functions.binding import numbers
from locuspark.model import Field, VariantSet

_KEPT = ("samples", "contigs", "filters", "contig_lengths", "filter_descriptions", "source", "meta", "max_alleles", "max_rlen", "ploidy", "block")
#: Samples above which call columns are cut into blocks, and samples of a block.
MANY, BLOCK = 2000, 1000
#: What a task sorts and writes: bytes of its rows, of which each has so many beside so many a sample; tasks at most, rows for which another core is used, and cells of a task's range.
TASK, ROW, CALL, TASKS, FEW, CELLS = 128 << 20, 300, 80, 4096, 10_000, 16


def blocked(vs: VariantSet, size: int) -> VariantSet:
    """The call columns cut into blocks of ``size`` samples."""
    names = [c for c in vs.df.columns if c in ("gt", "phased") or c.startswith("fmt_")]
    if vs.block is not None or not names:
        return vs
    cut = {f"{c}__{k}": F.slice(F.col(c), k * size + 1, size) for c in names for k in range(-(-len(vs.samples) // size))}
    return replace(vs, df=vs.df.select(*[c for c in vs.df.columns if c not in names], *[v.alias(c) for c, v in cut.items()]), block=size)


def ranged(vs: VariantSet, df: DataFrame) -> DataFrame:
    """``df``, the rows of ``vs``, in tasks by ranges of variant_index.

    The bounds are quantiles of the index alone. ``repartitionByRange`` computes
    whole rows to sample their keys, and then all of them again.
    """
    index = F.col("variant_index")
    shares = [k / TASKS for k in range(1, TASKS)]
    n, low, high, cuts = vs.reading([]).df.select(index).agg(F.count("*"), F.min(index), F.max(index), F.percentile_approx(index, shares, 10_000)).first()
    least = min(df.sparkSession.sparkContext.defaultParallelism, n // FEW + 1)
    tasks = min(TASKS, max(least, n * (ROW + CALL * len(vs.samples)) // TASK + 1))
    if tasks == 1:
        return df.repartitionById(1, F.lit(0))
    # A range is a run of cells of equal width, so that a row finds its task by one division.
    width = (high - low) // (tasks * CELLS) + 1
    bounds = [cuts[k * TASKS // tasks - 1] for k in range(1, tasks)]
    task_of = np.searchsorted(bounds, low + width * np.arange((high - low) // width + 1), side="right")
    cell = F.expr(f"cast(least(greatest((variant_index - {low}L) div {width}L, 0L), {len(task_of) - 1}L) as int)")
    return df.repartitionById(tasks, F.get(numbers(task_of), cell))


def write(vs: VariantSet, path: str, block: int | None = None) -> None:
    """Rows range-partitioned and sorted by variant_index, so that row groups prune by position.

    ``block``: samples of a block of the call columns (0: never cut; None: where there are many samples).
    """
    rows = vs
    if block or (block is None and len(vs.samples) > MANY):
        vs = blocked(vs, block or BLOCK)
    spark = vs.df.sparkSession
    ranged(rows, vs.df).sortWithinPartitions("variant_index").write.mode("overwrite").parquet(f"{path}/variants")
    about = {k: getattr(vs, k) for k in _KEPT} | {"fields": [asdict(f) for f in vs.fields]}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read(spark: SparkSession, path: str) -> VariantSet:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in about.items() if k not in ("fields", "meta")}
    return VariantSet(spark.read.parquet(f"{path}/variants"), fields=tuple(Field(**f) for f in about["fields"]), meta=tuple(tuple(m) for m in about["meta"]), **tuples)


def from_frame(df, samples, contigs, **more) -> VariantSet:
    """A variant set over any DataFrame with the model's columns; ``rlen`` defaults to the length of ``ref``."""
    if "rlen" not in df.columns:
        df = df.withColumn("rlen", F.length("ref"))
    return VariantSet(df, tuple(samples), tuple(contigs), **more)
