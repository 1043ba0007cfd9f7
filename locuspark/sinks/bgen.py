"""BGEN layout 2, 8 bits, zlib: variant blocks as a binary column, the file, and its ``.sample`` and ``.bgi`` sidecars.

Hard calls become probabilities of one. A variant is phased if all its samples
are. Blocks are either as short as they can be, or of one fixed size: then the
strings share a byte budget, filled up in the unused identifier, and genotypes
are stored uncompressed.
"""

from __future__ import annotations

import array
import contextlib
import logging
import os
import sqlite3
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions.sentinels import INT_MISSING, INT_PAD
from locuspark.model import VariantSet
from locuspark.plans.resolve import result
from locuspark.sinks.calls import settled, tensor, whole_calls
from locuspark.sinks.ordered import binary_parts, index_bounds, opened, rows_in_order, running, write_bytes

log = logging.getLogger(__name__)

# Fixed values of the format.
MAGIC, HEADER_BYTES = b"bgen", 20
ZLIB, LAYOUT, HAS_SAMPLES = 1, 2 << 2, 1 << 31
BITS = 8
#: Bytes of a variant block beside its strings and its compressed genotypes.
AROUND = 28
LONGEST = 0xFFFF
SEVERAL = "BGEN files hold two alleles a variant here; use --max-alleles 2 to skip others"


@dataclass(frozen=True)
class Layout:
    """How blocks are written. budget: bytes of the five strings in fixed-size blocks; None: blocks of any size."""

    level: int = 1
    unphased: bool = False
    id_slot: str = "rsid"
    budget: int | None = None
    pad: bytes = b"."

    def __post_init__(self):
        if self.id_slot not in ("rsid", "varid"):
            raise ValueError(f"the variant identifier goes to 'rsid' or 'varid', not {self.id_slot!r}")
        if not -1 <= self.level <= 9:
            raise ValueError(f"compression levels are -1 to 9, not {self.level}")
        if not isinstance(self.pad, bytes) or len(self.pad) != 1 or self.pad == b"\0":
            raise ValueError(f"the padding is one byte other than NUL, not {self.pad!r}")
        if self.budget is not None and not 5 <= self.budget <= LONGEST:
            raise ValueError(f"the byte budget of the strings is 5 to {LONGEST}, not {self.budget}")


def sample_block(samples: Sequence[str]) -> bytes:
    names = [s.encode() for s in samples]
    if too_long := [s for s, b in zip(samples, names, strict=True) if len(b) > LONGEST]:
        raise ValueError(f"the sample name {too_long[0][:40]!r}... has more than {LONGEST} bytes")
    body = b"".join(struct.pack("<H", len(b)) + b for b in names)
    return struct.pack("<II", 8 + len(body), len(names)) + body


def header(n_variants: int, samples: Sequence[str], embed: bool = True) -> bytes:
    """What stands before the first variant block."""
    names = sample_block(samples) if embed else b""
    flags = ZLIB | LAYOUT | (HAS_SAMPLES if embed else 0)
    return struct.pack("<IIII4sI", HEADER_BYTES + len(names), HEADER_BYTES, n_variants, len(samples), MAGIC, flags) + names


def stored(data: bytes) -> bytes:
    """A zlib stream of stored blocks, each as long as it may be, so that its size follows from that of ``data``."""
    parts = [b"\x78\x01"]
    for at in range(0, max(len(data), 1), LONGEST):
        part = data[at : at + LONGEST]
        parts += [struct.pack("<BHH", at + LONGEST >= len(data), len(part), len(part) ^ LONGEST), part]
    return b"".join([*parts, struct.pack(">I", zlib.adler32(data))])


def stored_size(n: int) -> int:
    return 6 + n + 5 * max(1, -(-n // LONGEST))


def genotype_blocks(calls: np.ndarray, phased: np.ndarray) -> list[bytes]:
    """The uncompressed genotypes of each variant from its calls, (variants, samples, 2), and whether all are phased."""
    a, b = calls[..., 0], calls[..., 1]
    if ((a < INT_PAD) | (a > 1) | (b < INT_PAD) | (b > 1)).any():
        raise ValueError("a call has an allele that a variant with one ALT does not have")
    if (a == INT_PAD).any():
        raise ValueError("a call has no allele at all")
    rows, n = a.shape
    haploid = b == INT_PAD
    known = (a != INT_MISSING) & (b != INT_MISSING)
    ploidy = np.where(haploid, 1, 2).astype(np.uint8)
    apart = haploid | phased[:, None]
    shares = np.empty((rows, n, 2), np.uint8)
    shares[..., 0] = (np.where(apart, a == 0, (a == 0) & (b == 0)) & known) * 255
    shares[..., 1] = (np.where(phased[:, None], b == 0, a + b == 1) & known) * 255
    heads = ploidy | (~known).astype(np.uint8) << 7
    least, most = (ploidy.min(axis=1), ploidy.max(axis=1)) if n else (np.full(rows, 2), np.full(rows, 2))
    used = np.stack([np.ones_like(haploid), ~haploid], axis=2)
    out = []
    for k in range(rows):
        body = shares[k].tobytes() if least[k] == 2 else shares[k][used[k]].tobytes()
        out.append(struct.pack("<IHBB", n, 2, int(least[k]), int(most[k])) + heads[k].tobytes() + bytes([bool(phased[k]), BITS]) + body)
    return out


def strings(chrom: str, pos: int, ident: str, ref: str, alt: str, layout: Layout) -> list[bytes]:
    """varid, rsid, chrom, first and second allele; in a fixed layout the unused identifier takes up the rest of the budget."""
    own, *others = (x.encode() for x in (ident, chrom, ref, alt))
    filler = b"."
    if layout.budget is not None:
        rest = layout.budget - len(own) - sum(map(len, others))
        if rest < 1:
            raise ValueError(f"the strings of the variant at {chrom}:{pos} need {layout.budget - rest} bytes, and one more for the padding; the budget is {layout.budget}")
        filler += layout.pad * (rest - 1)
    return [*([filler, own] if layout.id_slot == "rsid" else [own, filler]), *others]


def block(texts: list[bytes], pos: int, genotypes: bytes, layout: Layout) -> bytes:
    varid, rsid, chrom, ref, alt = texts
    body = stored(genotypes) if layout.level == 0 else zlib.compress(genotypes, layout.level)
    head = b"".join(struct.pack("<H", len(x)) + x for x in (varid, rsid, chrom)) + struct.pack("<IH", pos, 2)
    return head + b"".join(struct.pack("<I", len(x)) + x for x in (ref, alt)) + struct.pack("<II", 4 + len(body), len(genotypes)) + body


def _phases(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether all calls of each row are phased, and whether any is; a missing flag is none, a row without flags neither."""
    size = np.asarray(col.value_lengths().fill_null(0))
    flags = col.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(size)
    phased = count[ends] - count[ends - size]
    # Like Python's all(): a row of no samples is phased, one that is null is not.
    return (phased == size) & ~np.asarray(col.is_null()), phased > 0


def blocks(vs: VariantSet, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """``variant_index, chrom, pos, rsid, ref, alt, mixed, block`` in no order; mixed: its samples differ in phase."""
    n, uniform = len(vs.sample_ids), vs.ploidy
    vs = vs.reading(["GT", "ID", "REF", "ALT"])
    df = result(vs).df
    phased = F.lit(None).cast("array<boolean>") if layout.unphased or not vs.has("phased") else vs.call("phased")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            calls = tensor(batch.column("calls"), n)
            if layout.budget is not None and ((calls[..., 1] == INT_PAD) != (uniform == 1)).any():
                raise NotImplementedError("blocks of a fixed size need one ploidy for all; write blocks of any size instead")
            whole, some = _phases(batch.column("phased"))
            rows = zip(*(batch.column(c).to_pylist() for c in ("chrom", "pos", "id", "ref", "alt")), genotype_blocks(calls, whole), strict=True)
            made, rsid, mixed = [], [], some & ~whole
            for chrom, pos, ident, ref, alt, genotypes in rows:
                texts = strings(chrom, pos, ident, ref, alt, layout)
                rsid.append(texts[1].decode())
                made.append(block(texts, pos, genotypes, layout))
            yield pa.RecordBatch.from_arrays(
                [batch.column("variant_index"), *(batch.column(c) for c in ("chrom", "pos")), pa.array(rsid, pa.string()), *(batch.column(c) for c in ("ref", "alt")), pa.array(mixed), pa.array(made, pa.binary())],
                names=["variant_index", "chrom", "pos", "rsid", "ref", "alt", "mixed", "block"],
            )

    own = df.select("variant_index", "chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), "ref", F.coalesce(F.get("alts", F.lit(0)), F.lit(".")).alias("alt"), phased.alias("phased"), whole_calls(vs, SEVERAL).alias("calls"))
    return own.mapInArrow(run, "variant_index long, chrom string, pos long, rsid string, ref string, alt string, mixed boolean, block binary")


def index_rows(vs: VariantSet, layout: Layout = Layout(), embed: bool = True) -> DataFrame:  # noqa: B008
    """The rows of a ``.bgi``: ``variant_index, chrom, pos, rsid, ref, alt, start, size``, computed in parallel."""
    before = len(header(0, vs.sample_ids, embed))
    sized = blocks(vs, layout).select("variant_index", "chrom", "pos", "rsid", "ref", "alt", F.octet_length("block").cast("long").alias("size"))
    return running(sized, "size", "start", before)


def sample_text(samples: Sequence[str]) -> str:
    for s in samples:
        if any(c.isspace() for c in s):
            raise ValueError(f"the sample name {s!r} has white space, which separates columns in .sample files")
    return "ID_1 ID_2 missing\n0 0 0\n" + "".join(f"{s} {s} 0\n" for s in samples)


def write_sample(vs: VariantSet, output) -> None:
    with opened(output) as f:
        f.write(sample_text(vs.sample_ids))


# The index that readers of the format expect: a fixed schema.
_SCHEMA = """
CREATE TABLE Variant (
  chromosome TEXT NOT NULL, position INT NOT NULL, rsid TEXT NOT NULL, number_of_alleles INT NOT NULL, allele1 TEXT NOT NULL, allele2 TEXT NULL,
  file_start_position INT NOT NULL, size_in_bytes INT NOT NULL, PRIMARY KEY (chromosome, position, rsid, allele1, allele2, file_start_position)
)"""
_ORDER = "CREATE INDEX position_idx ON Variant (chromosome, position)"


def write_index_rows(path: str, rows: Iterable[tuple]) -> None:
    """A ``.bgi`` from (chrom, pos, rsid, ref, alt, start, size)."""
    with contextlib.suppress(FileNotFoundError):
        os.remove(path)
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute(_SCHEMA)
        db.executemany("INSERT INTO Variant VALUES (?, ?, ?, 2, ?, ?, ?, ?)", rows)
        db.execute(_ORDER)
        db.commit()


def write_bgi(vs: VariantSet, path: str, offsets: Sequence[int], id_slot: str = "rsid", budget: int | None = None, pad: bytes = b".") -> None:
    """The index of a file whose blocks begin at ``offsets`` (one more than variants: the last is the end)."""
    layout = Layout(id_slot=id_slot, budget=budget, pad=pad)
    own = result(vs.reading(["ID", "REF", "ALT"])).df.select("variant_index", "chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), "ref", F.when(F.size("alts") > 1, F.raise_error(F.lit(SEVERAL))).otherwise(F.coalesce(F.get("alts", F.lit(0)), F.lit("."))).alias("alt"))
    if len(offsets) != own.count() + 1:
        raise ValueError(f"{len(offsets)} offsets do not fit {own.count()} variants: one more is needed than there are variants")

    def rows() -> Iterator[tuple]:
        for r, (start, end) in zip(rows_in_order(own), pairwise(offsets), strict=True):
            rsid = strings(r["chrom"], r["pos"], r["id"], r["ref"], r["alt"], layout)[1].decode()
            yield r["chrom"], r["pos"], rsid, r["ref"], r["alt"], int(start), int(end) - int(start)

    write_index_rows(path, rows())


def write_parts(vs: VariantSet, path: str, layout: Layout = Layout()) -> None:  # noqa: B008
    """Under ``path``: ``head``, and blocks in numbered parts behind it (together a file), ``index`` (rows of the ``.bgi``, as Parquet) and ``sample``.

    Executors write the parts; nothing but the head passes through the driver.
    """
    settled(vs, "write_parts")
    made = blocks(vs, layout)
    write_bytes(vs.df.sparkSession, f"{path}/head", header(result(vs.reading(["ALT"])).df.count(), vs.sample_ids))
    write_bytes(vs.df.sparkSession, f"{path}/sample", sample_text(vs.sample_ids).encode())
    binary_parts(made, "block", f"{path}/blocks", *index_bounds(result(vs.reading([])).df))
    index_rows(vs, layout).write.parquet(f"{path}/index")


def write_bgen(
    vs: VariantSet, output, sample_path: str | None = None, bgi_path: str | None = None, embed_header_samples: bool = True, compression_level: int | None = None, unphased: bool = False,
    variant_id_field: str = "rsid", fixed_variant_size: bool = False, total_string_length: int | None = None, pad_byte: bytes | None = None,
) -> list[int]:
    """A BGEN file to a path or a binary file, and its sidecars; returns where each block begins, and the end."""
    if not fixed_variant_size and (total_string_length is not None or pad_byte is not None):
        raise ValueError("total_string_length and pad_byte need fixed_variant_size")
    if fixed_variant_size and compression_level not in (None, 0):
        raise ValueError(f"fixed_variant_size needs compression level 0, not {compression_level}")
    settled(vs, "write_bgen")
    if compression_level is None:
        compression_level = 0 if fixed_variant_size else 1
    budget = (64 if total_string_length is None else total_string_length) if fixed_variant_size else None
    layout = Layout(compression_level, unphased, variant_id_field, budget, b"." if pad_byte is None else pad_byte)
    if not embed_header_samples and sample_path is None:
        log.warning("no sample names are written anywhere; most readers need them in the header or in a .sample file")
    if sample_path is not None:
        write_sample(vs, sample_path)
    offsets, mixed = array.array("q"), 0

    def rows(f) -> Iterator[tuple]:
        nonlocal mixed
        at = f.write(header(result(vs.reading(["ALT"])).df.count(), vs.sample_ids, embed_header_samples))
        offsets.append(at)
        for r in rows_in_order(blocks(vs, layout)):
            f.write(r["block"])
            mixed += r["mixed"]
            at += len(r["block"])
            offsets.append(at)
            yield r["chrom"], r["pos"], r["rsid"], r["ref"], r["alt"], offsets[-2], len(r["block"])

    with opened(output, "wb") as f:
        if bgi_path is not None:
            write_index_rows(bgi_path, rows(f))
        else:
            for _ in rows(f):
                pass
    if mixed:
        log.warning("%d variant(s) mix phased and unphased samples and were written unphased", mixed)
    return list(offsets)
