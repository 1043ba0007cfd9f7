"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes.util
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the setting is unset and the master is local (tests, a laptop) is
    a local one made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="locuspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/locuspark-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, folder = _file_system(spark, path)
    system.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`written` that is no longer needed."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles() if "/locuspark-" in f}:
        system, folder = _file_system(df.sparkSession, name)
        system.delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(it: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each."""
    for batch in it:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def map_text(df: DataFrame, fn: Callable, schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``fn``: record batch to columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))
    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((pa.RecordBatch.from_arrays(b.columns, names=names) for b in it), column):
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_arrow(out[f.name], f.type) for f in want], schema=want)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)  # any names are allowed in between


def _arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def trimmed(run: Callable) -> Callable:
    """A kernel whose worker, which lives on for other tasks, gives back what it has freed when the task ends."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
        if trim is not None:
            trim(0)

    return kernel


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names`` of ``df``; columns that merely clash with ours are left behind."""
    return df.select(*[df[f"`{n}`"] for n in names])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
