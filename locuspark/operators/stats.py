"""Record counts, whole and by contig."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.model import VariantSet


def contig_counts(vs: VariantSet) -> DataFrame:
    """``contig_index, contig, length, records`` of contigs that have records; an unknown length is a dot."""
    vs = vs.reading([])
    lengths = vs.contig_lengths or [None] * len(vs.contigs)
    table = vs.df.sparkSession.createDataFrame([(i, c, None if n is None else int(n)) for i, (c, n) in enumerate(zip(vs.contigs, lengths, strict=True))], "contig_index int, contig string, length long")
    counts = vs.df.groupBy("chrom").agg(F.count("*").alias("records"))
    return counts.join(table, counts.chrom == table.contig).select("contig_index", "contig", F.coalesce(F.col("length").cast("string"), F.lit(".")).alias("length"), "records")


def write_count(vs: VariantSet, output) -> None:
    print(vs.num_variants(), file=output)


def write_contig_counts(vs: VariantSet, output) -> None:
    for r in contig_counts(vs).orderBy("contig_index").toLocalIterator():  # a row a contig
        print(r["contig"], r["length"], r["records"], sep="\t", file=output)
