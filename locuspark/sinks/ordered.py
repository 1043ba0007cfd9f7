"""Ordered output: single files, for which rows pass through the driver a partition at a time, and parts that executors write."""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Variants whose sizes or ranks are summed in one window.
GROUP = 1 << 16


@contextlib.contextmanager
def opened(output, mode: str = "w"):
    """A path opened, or a file as it is."""
    if hasattr(output, "write"):
        yield output
    else:
        with open(output, mode) as f:
            yield f


def rows_in_order(df: DataFrame) -> Iterator:
    """Rows in variant order, streamed."""
    yield from df.orderBy("variant_index").toLocalIterator(prefetchPartitions=True)


def in_order(df: DataFrame, column: str, end: str = "") -> Iterator[bytes]:
    """A text or binary column in variant order, streamed: many values a piece, each followed by ``end``."""
    close = end.encode()

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                values = batch.column(0).cast(pa.binary())
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), close)
                yield pa.RecordBatch.from_arrays([whole], names=["piece"])

    pieces = df.select("variant_index", column).orderBy("variant_index").select(column).mapInArrow(joined, "piece binary")
    for row in pieces.toLocalIterator(prefetchPartitions=True):
        yield bytes(row["piece"]) + close


def running(df: DataFrame, size: str, name: str, start: int = 0) -> DataFrame:
    """``df`` and the sum of column ``size`` over all rows before each, in variant order.

    Two levels: sums of groups of ``GROUP`` indexes, and windows inside them. Only
    the sums, one row a group, meet in one task.
    """
    group = F.floor(F.col("variant_index") / GROUP).cast("long")
    rows = df.withColumn("_group", group)
    sums = rows.groupBy("_group").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_group").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group").orderBy("variant_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = rows.join(sums, F.col("_group") == F.col("_of"))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside") + start).cast("long").alias(name))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:/") else os.path.abspath(path))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on the cluster's storage."""
    system, name = _file_system(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(data)


def binary_parts(df: DataFrame, column: str, path: str, first: int, last: int) -> None:
    """A binary column in variant order, in files ``part-00000`` and on that executors write; one after the other they are the whole.

    Each part has a range of the indexes from ``first`` to ``last``, which it is
    named by, so a task that runs again writes the same file anew.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _file_system(path)
        system.create_dir(folder, recursive=True)
        size = 0
        own = f"{folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        with system.open_output_stream(own) as f:
            for batch in it:
                for value in batch.column(column):
                    size += f.write(value.as_buffer())
        system.move(own, f"{folder}/part-{context.partitionId():05d}")
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor((F.col("variant_index") - first) * n / max(1, last - first + 1)).cast("int")
    rows = df.select("variant_index", column, part.alias("_part")).repartitionById(n, "_part").sortWithinPartitions("variant_index")
    rows.mapInArrow(run, "size long").agg(F.sum("size")).collect()


def index_bounds(df: DataFrame) -> tuple[int, int]:
    """The least and the largest variant_index."""
    low, high = df.agg(F.min("variant_index"), F.max("variant_index")).first()
    return low or 0, high or 0
