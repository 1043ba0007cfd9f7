"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.frames import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to stars ``(root, node)``; root is the smallest node.

    Nodes without an edge, nulls and loops give no row; repeated edges count
    once. Each round is written to the shared folder, so lineage stays short.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    now = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("root"), F.col("b").alias("node"))
        seen = mark
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").where("u > m").distinct()
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        joined = large.join(low, "u")
        small = joined.where("m > low").select(F.col("low").alias("a"), F.col("m").alias("b"))
        nxt = written(small.union(joined.select(F.col("low").alias("a"), F.col("u").alias("b"))).distinct(), "edges")
        drop_written(now)
        now = nxt
