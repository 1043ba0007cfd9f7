"""PLINK 1 filesets: ``.bed`` blocks as a binary column, ``.bim`` as columns, ``.fam`` from the sample names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions.sentinels import INT_PAD
from locuspark.model import VariantSet
from locuspark.plans.resolve import result
from locuspark.sinks.calls import settled, tensor, whole_calls
from locuspark.sinks.ordered import binary_parts, in_order, index_bounds, opened, write_bytes

MAGIC = bytes([0x6C, 0x1B, 0x01])
# Two-bit codes of a call.
HOM_ALT, MISSING, HET, HOM_REF = 0, 1, 2, 3
_STANDARD = [*(str(n) for n in range(1, 23)), "X", "Y", "MT"]
SEVERAL = "PLINK 1 files hold two alleles a variant; use --max-alleles 2 to skip others"


def codes(calls: np.ndarray) -> np.ndarray:
    """Two-bit codes of a tensor of calls; a haploid call counts twice, alleles beyond 1 are missing."""
    a, b = calls[..., 0], calls[..., 1]
    b = np.where(b == INT_PAD, a, b)
    known = (a >= 0) & (a <= 1) & (b >= 0) & (b <= 1)
    table = np.array([HOM_REF, HET, HOM_ALT], np.uint8)
    return np.where(known, table[np.where(known, a + b, 0)], MISSING).astype(np.uint8)


def packed(two_bit: np.ndarray) -> np.ndarray:
    """Four codes a byte, the first in the low bits; the last byte is padded with zeros."""
    rows, n = two_bit.shape
    wide = np.zeros((rows, -(-n // 4) * 4), np.uint8)
    wide[:, :n] = two_bit
    return wide[:, 0::4] | wide[:, 1::4] << 2 | wide[:, 2::4] << 4 | wide[:, 3::4] << 6


def bed(vs: VariantSet) -> DataFrame:
    """``variant_index, bed``: the block of each variant, in no order."""
    n = len(vs.sample_ids)
    vs = vs.reading(["GT", "ALT"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            blocks = packed(codes(tensor(batch.column("calls"), n)))
            yield pa.RecordBatch.from_arrays([batch.column("variant_index"), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["variant_index", "bed"])

    return result(vs).df.select("variant_index", whole_calls(vs, SEVERAL).alias("calls")).mapInArrow(run, "variant_index long, bed binary")


def bim(vs: VariantSet) -> DataFrame:
    """``variant_index, chrom, id, cm, pos, a1, a2``: a1 is the ALT, standard human contigs lose their ``chr``."""
    vs = vs.reading(["ID", "REF", "ALT"])
    bare = F.substring("chrom", 4, 1 << 30)
    chrom = F.when(F.col("chrom") == "chrM", "MT").when(F.startswith("chrom", F.lit("chr")) & bare.isin(_STANDARD), bare).otherwise(F.col("chrom"))
    a1 = F.when(F.size("alts") > 1, F.raise_error(F.lit(SEVERAL))).otherwise(F.coalesce(F.get("alts", F.lit(0)), F.lit(".")))
    return result(vs).df.select("variant_index", chrom.alias("chrom"), F.coalesce("id", F.lit(".")).alias("id"), F.lit(0).alias("cm"), F.col("pos"), a1.alias("a1"), F.col("ref").alias("a2"))


def fam(samples: tuple[str, ...]) -> str:
    for s in samples:
        if any(c.isspace() for c in s):
            raise ValueError(f"the sample name {s!r} has white space, which separates columns in .fam files")
    return "".join(f"{s}\t{s}\t0\t0\t0\t-9\n" for s in samples)


def write_fam(vs: VariantSet, output) -> None:
    with opened(output) as f:
        f.write(fam(vs.sample_ids))


def write_bim(vs: VariantSet, output) -> None:
    line = bim(vs).select("variant_index", F.concat_ws("\t", "chrom", "id", "cm", "pos", "a1", "a2").alias("line"))
    with opened(output) as f:
        for piece in in_order(line, "line", "\n"):
            f.write(piece.decode())


def write_bed(vs: VariantSet, output) -> None:
    with opened(output, "wb") as f:
        f.write(MAGIC)
        for block in in_order(bed(vs), "bed"):
            f.write(block)


def write_plink(vs: VariantSet, stem: str, bim: bool = True, fam: bool = True) -> None:
    """``stem.bed`` and, if wanted, ``stem.bim`` and ``stem.fam``; the stem is taken as it is."""
    settled(vs, "write_plink")
    if fam:
        write_fam(vs, f"{stem}.fam")
    if bim:
        write_bim(vs, f"{stem}.bim")
    write_bed(vs, f"{stem}.bed")


def write_parts(vs: VariantSet, path: str) -> None:
    """Under ``path``: ``head`` and numbered parts of ``bed`` (together the ``.bed``), ``bim`` as sorted text parts, and ``fam``; executors write them."""
    settled(vs, "write_parts")
    spark = vs.df.sparkSession
    write_bytes(spark, f"{path}/head", MAGIC)
    write_bytes(spark, f"{path}/fam", fam(vs.sample_ids).encode())
    binary_parts(bed(vs), "bed", f"{path}/bed", *index_bounds(result(vs.reading([])).df))
    line = bim(vs).select("variant_index", F.concat_ws("\t", "chrom", "id", "cm", "pos", "a1", "a2").alias("line"))
    line.orderBy("variant_index").select("line").write.text(f"{path}/bim")
