"""Variants that keep arriving as Parquet files: the row-wise operators over a stream.

Selection, filters, derived fields, formats and record lines look at one row at
a time, so they run on a streaming DataFrame as they are, without state. Order
over the whole set exists in batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from locuspark.model import VariantSet
from locuspark.sources import tables


def follow(spark: SparkSession, path: str, files_per_trigger: int = 64) -> VariantSet:
    """The variant set at ``path``, reading files as they are added to it."""
    known = tables.read(spark, path)
    return known.with_frame(spark.readStream.schema(known.df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}/variants"))


def append(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes streaming rows as Parquet, exactly once; ``trigger``: as for ``DataStreamWriter.trigger``."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start(path)
