"""Numbers as text, by three rules: shortest repr, ``%g``, and three decimals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by_value(col: pa.Array, one: Callable[[float], str]) -> pa.Array:
    """Floats, in lists of any depth, to strings; nulls stay, each different value is rendered once."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_list(col.type):
        valid = col.is_valid()
        ends = pa.array(np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]), pa.int32())
        return pa.ListArray.from_arrays(ends, _by_value(col.flatten(), one), mask=pa.compute.invert(valid))
    coded = col.dictionary_encode()
    return pa.array([one(x) for x in coded.dictionary.to_numpy(zero_copy_only=False)], pa.string()).take(coded.indices)


def _renderer(kind: T.DataType, one: Callable[[float], str]):
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1

    def run(col: pa.Array) -> pa.Array:
        return _by_value(col, one)

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<" * depth + "string" + ">" * depth)


def general(col: Column) -> Column:
    """C's ``%g``."""
    return _renderer(T.DoubleType(), lambda x: f"{x:g}")(col.cast("double"))


def texts(col: Column, kind: T.DataType) -> Column:
    """A scalar or a vector (of vectors) as strings in the same shape, NULL where missing; floats by their shortest repr."""
    inner, depth = kind, 0
    while isinstance(inner, T.ArrayType):
        inner, depth = inner.elementType, depth + 1
    if isinstance(inner, (T.FloatType, T.DoubleType)):
        return _renderer(kind, str)(col)  # the values come as numpy scalars of the column's own width
    if isinstance(inner, T.BooleanType):
        return F.when(col, "True")
    return col.cast("array<" * depth + "string" + ">" * depth)


def three_decimals(x: Column) -> Column:
    """At most three decimals, half away from zero, trailing zeros dropped; ``%.3f`` for huge and non-finite values."""
    v = x.cast("double")
    k = F.floor(F.abs(v) * 1000 + 0.5).cast("long")
    rest = F.rtrim(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("0"))
    plain = F.concat(F.when(v < 0, "-").otherwise(""), F.floor(k / 1000).cast("long").cast("string"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.when(x.isNull(), None).when(F.isnan(v) | (F.abs(v) == float("inf")), odd).when(F.abs(v) > 2147483648.0, F.format_string("%.3f", v)).otherwise(plain)


def vcf_text(col: Column, kind: T.DataType, key: str = "") -> Column:
    """A scalar or vector as VCF text: NULL where a scalar is missing, ``.`` for a missing element.

    Integers that need more than 32 bits are an error that names ``key``.
    """
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(col, lambda e: F.coalesce(vcf_text(e, kind.elementType, key), F.lit("."))), ",")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return three_decimals(col)
    if isinstance(kind, T.LongType):
        wide = (col > 2147483647) | (col < -2147483648)
        return F.when(wide, F.raise_error(F.concat(F.lit(f"a value of {key} does not fit 32 bits: "), col.cast("string")))).otherwise(col.cast("string"))
    return col.cast("string")
