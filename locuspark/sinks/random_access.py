"""Byte ranges of fixed-stride files that are never written: each read is a bounded query.

The driver keeps one variant_index for every ``rows_per_block`` variants, found
by a distributed rank. A read selects the variants between two of those marks
(a range that the scan can prune), encodes them on the executors and slices
the result; the last block stays in memory.
"""

from __future__ import annotations

import abc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.model import VariantSet
from locuspark.plans.resolve import result
from locuspark.sinks import bgen, plink
from locuspark.sinks.calls import settled
from locuspark.sinks.ordered import running

BLOCK_BYTES = 10 << 20


class FormatEncoder(abc.ABC):
    """A virtual file: ``prefix``, then ``bytes_per_variant`` bytes for each variant in order."""

    def __init__(self, vs: VariantSet, bytes_per_variant: int, prefix: bytes, block_bytes: int = BLOCK_BYTES):
        if block_bytes < 1:
            raise ValueError(f"blocks have at least one byte, not {block_bytes}")
        settled(vs, type(self).__name__)
        self.vs, self.prefix, self._stride = vs, prefix, bytes_per_variant
        self._rows = max(1, block_bytes // max(1, bytes_per_variant))
        self._marks: list[int] | None = None
        self._count: int | None = None
        self._held: tuple[int, bytes] | None = None
        self._closed = False

    @abc.abstractmethod
    def encode(self, vs: VariantSet) -> DataFrame:
        """``variant_index, block`` with ``bytes_per_variant`` bytes in each."""

    # --- sizes --------------------------------------------------------------------
    def _open(self) -> None:
        if self._closed:
            raise RuntimeError("the encoder is closed")

    @property
    def num_variants(self) -> int:
        self._open()
        if self._count is None:
            self._count = result(self.vs.reading([])).df.count()
        return self._count

    @property
    def num_samples(self) -> int:
        self._open()
        return len(self.vs.sample_ids)

    @property
    def bytes_per_variant(self) -> int:
        self._open()
        return self._stride

    @property
    def prefix_size(self) -> int:
        self._open()
        return len(self.prefix)

    @property
    def total_size(self) -> int:
        return self.prefix_size + self.num_variants * self._stride

    @property
    def variant_offsets(self) -> range:
        """Where each variant begins, and the end."""
        return range(self.prefix_size, self.total_size + 1, self._stride)

    # --- reads --------------------------------------------------------------------
    def _range(self, off: int, size: int) -> tuple[int, int]:
        self._open()
        if off < 0 or size < 0:
            raise ValueError(f"offset and size must not be negative: {off}, {size}")
        return off, min(off + size, self.total_size)

    def _block(self, k: int) -> bytes:
        """The bytes of the ``k``-th run of ``rows_per_block`` variants."""
        if self._marks is None:
            ranks = running(result(self.vs.reading([])).df.select("variant_index", F.lit(1).alias("one")), "one", "rank")
            self._marks = sorted(r["variant_index"] for r in ranks.where(F.col("rank") % self._rows == 0).select("variant_index").collect())
        if self._held is None or self._held[0] != k:
            index = F.col("variant_index")
            part = self.vs.df.where(index >= self._marks[k])
            if k + 1 < len(self._marks):
                part = part.where(index < self._marks[k + 1])
            got = self.encode(self.vs.with_frame(part)).orderBy("variant_index").collect()  # at most rows_per_block
            self._held = (k, b"".join(bytes(r[1]) for r in got))
        return self._held[1]

    def read(self, off: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``off``; nothing beyond the end."""
        off, end = self._range(off, size)
        out = [self.prefix[off:end]] if off < end else []
        at = max(off, len(self.prefix))
        while at < end:
            k, skip = divmod(at - len(self.prefix), self._rows * self._stride)
            part = self._block(k)[skip : skip + end - at]
            out.append(part)
            at += len(part)
        return b"".join(out)

    def try_cached_read(self, off: int, size: int) -> bytes | None:
        """As :meth:`read`, if no query is needed for it."""
        off, end = self._range(off, size)
        if off >= end:
            return b""
        first = max(off, len(self.prefix)) - len(self.prefix)
        if end > len(self.prefix):
            if self._held is None:
                return None
            low = self._held[0] * self._rows * self._stride
            if first < low or end - len(self.prefix) > low + len(self._held[1]):
                return None
        return self.read(off, size)

    def write_to(self, out, off: int = 0, size: int | None = None, block: int = BLOCK_BYTES) -> int:
        """Copies a range to a binary file; returns how many bytes."""
        off, end = self._range(off, self.total_size if size is None else size)
        done = 0
        while off + done < end:
            done += out.write(self.read(off + done, min(block, end - off - done)))
        return done

    def close(self) -> None:
        self._closed, self._held = True, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class BedEncoder(FormatEncoder):
    """A virtual ``.bed``."""

    def __init__(self, vs: VariantSet, block_bytes: int = BLOCK_BYTES):
        super().__init__(vs, -(-len(vs.sample_ids) // 4), plink.MAGIC, block_bytes)

    bed_size = FormatEncoder.total_size

    def encode(self, vs: VariantSet) -> DataFrame:
        return plink.bed(vs)


class BgenEncoder(FormatEncoder):
    """A virtual BGEN file with blocks of one size."""

    def __init__(self, vs: VariantSet, total_string_length: int = 64, pad_byte: bytes = b".", variant_id_field: str = "rsid", embed_header_samples: bool = True, unphased: bool = False, block_bytes: int = BLOCK_BYTES):
        if vs.ploidy not in (1, 2):
            raise ValueError(f"ploidy 1 and 2 can be written, not {vs.ploidy}")
        if long := [c for c in vs.contigs if len(c.encode()) > bgen.LONGEST]:
            raise ValueError(f"the contig {long[0][:40]!r}... has more than {bgen.LONGEST} bytes")
        self.layout = bgen.Layout(0, unphased, variant_id_field, total_string_length, pad_byte)
        n = len(vs.sample_ids)
        stride = bgen.AROUND + total_string_length + bgen.stored_size(10 + (vs.ploidy + 1) * n)
        self._embed = embed_header_samples
        super().__init__(vs, stride, b"", block_bytes)
        self.prefix = bgen.header(self.num_variants, vs.sample_ids, embed_header_samples)

    header_size = FormatEncoder.prefix_size
    bgen_size = FormatEncoder.total_size

    def encode(self, vs: VariantSet) -> DataFrame:
        return bgen.blocks(vs, self.layout).select("variant_index", "block")
