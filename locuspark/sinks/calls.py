"""Genotype columns of Arrow batches as numpy tensors, and what the binary sinks share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from locuspark.functions.sentinels import INT_MISSING, INT_PAD
from locuspark.model import VariantSet


def settled(vs: VariantSet, what: str) -> None:
    """Binary sinks need a fixed selection of rows."""
    if vs.conditions:
        raise NotImplementedError(f"{what} needs a filter that has been evaluated; call materialised() first")


def whole_calls(vs: VariantSet, error: str) -> Column:
    """``gt`` of the selected samples; rows with several ALTs are an error, a missing row has missing diploid calls."""
    none = F.array_repeat(F.array(F.lit(None).cast("tinyint"), F.lit(None).cast("tinyint")), len(vs.sample_ids))
    return F.when(F.size("alts") > 1, F.raise_error(F.lit(error))).otherwise(F.coalesce(vs.call("gt"), none))


def tensor(col: pa.Array, n_samples: int) -> np.ndarray:
    """(rows, samples, 2) int8 of ``array<array<tinyint>>``: -1 missing, -2 a slot beyond the ploidy.

    A null call is a missing diploid one, an empty call has no slot at all.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = len(col)
    inner = col.flatten()
    if len(inner) != rows * n_samples:
        raise ValueError(f"{len(inner)} calls in {rows} rows of {n_samples} samples")
    size = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if (size > 2).any():
        raise ValueError("a call has more than two alleles; ploidy 1 and 2 can be written")
    values = inner.flatten().fill_null(INT_MISSING).to_numpy(zero_copy_only=False).astype(np.int8)
    start = np.cumsum(size) - size
    out = np.full((len(inner), 2), INT_PAD, np.int8)
    for slot in (0, 1):
        there = size > slot
        out[there, slot] = values[start[there] + slot]
    if inner.null_count:
        out[inner.is_null().to_numpy(zero_copy_only=False)] = INT_MISSING
    return out.reshape(rows, n_samples, 2)
