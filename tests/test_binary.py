"""PLINK and BGEN files, byte for byte, against small decoders and encoders written for the test."""

import io
import logging
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from cohort import made, tulips

from locuspark.sinks import bgen, plink
from locuspark.sinks.random_access import BedEncoder, BgenEncoder

GT = [
    [[0, 0], [0, 1], [1, 0], [1, 1], [-1, -1], [0, -1]], [[0], [1], [-1], [0, 0], [1, 1], [0, 1]], [[1, 1]] * 6, [[0, 0]] * 6, [[0, 1], [1, 0]] * 3,
]
PHASED = [[True] * 6, [False] * 6, [True] * 6, [True, False] * 3, [True] * 6]


@pytest.fixture(scope="module")
def five(spark):
    return made(spark, 5, fixed={"gt": GT, "phased": PHASED, "chrom": ["chr1", "chrM", "chrX", "chrUn", "7"], "id": ["rs1", None, "x", None, "longer"], "alts": [["T"], ["C"], ["G"], [], ["TT"]], "pos": [10, 20, 30, 40, 50]})


@pytest.fixture(scope="module")
def diploid(spark):
    rng = np.random.default_rng(5)
    n, s = 50, 7
    return made(spark, n, fixed={"gt": rng.integers(-1, 2, (n, s, 2)).tolist(), "phased": (rng.random((n, s)) < 0.9).tolist(), "id": [f"rs{k}" if k % 3 else None for k in range(n)], "pos": [5 * k + 1 for k in range(n)]})


def two_bits(call):
    a, b = (call * 2)[:2]
    return {(0, 0): 3, (1, 1): 0, (0, 1): 2, (1, 0): 2}.get((a, b), 1)


def bed_of(calls):
    out = bytearray([0x6C, 0x1B, 0x01])
    for row in calls:
        for k in range(0, len(row), 4):
            out.append(sum(two_bits(c) << 2 * i for i, c in enumerate(row[k : k + 4])))
    return bytes(out)


def test_plink(five, tmp_path):
    stem = str(tmp_path / "a.b")
    plink.write_plink(five, stem)
    assert open(stem + ".bed", "rb").read() == bed_of(GT)
    assert open(stem + ".bim").read() == "1\trs1\t0\t10\tT\tA\nMT\t.\t0\t20\tC\tA\nX\tx\t0\t30\tG\tA\nchrUn\t.\t0\t40\t.\tA\n7\tlonger\t0\t50\tTT\tA\n"
    assert open(stem + ".fam").read() == "".join(f"S{k}\tS{k}\t0\t0\t0\t-9\n" for k in range(6))
    plink.write_plink(five.with_samples(["S5", "S0"]), str(tmp_path / "c"), bim=False, fam=False)
    assert open(tmp_path / "c.bed", "rb").read() == bed_of([[r[5], r[0]] for r in GT]) and not (tmp_path / "c.bim").exists()


def test_plink_errors(spark, five):
    with pytest.raises(NotImplementedError, match="materialised"):
        plink.write_plink(five.with_filter("POS > 3"), "/nowhere")
    with pytest.raises(ValueError, match="white space"):
        plink.fam(("a b",))
    with pytest.raises(Exception, match="two alleles"):
        plink.write_bed(tulips(spark), io.BytesIO())


def decoded(data):
    """Header, sample names and variants of a BGEN file, by its specification."""
    offset, head, m, n, magic, flags = struct.unpack_from("<IIII4sI", data)
    assert head == 20 and magic == b"bgen" and flags & 0x3F == 1 | 2 << 2
    names, at = [], 24
    if flags >> 31:
        size, count = struct.unpack_from("<II", data, at)
        assert size + 20 == offset and count == n
        at += 8
        for _ in range(n):
            (k,) = struct.unpack_from("<H", data, at)
            names.append(data[at + 2 : at + 2 + k].decode())
            at += 2 + k
    assert at == offset + 4
    out = []
    while at < len(data):
        begin, texts = at, []
        for _ in range(3):
            (k,) = struct.unpack_from("<H", data, at)
            texts.append(data[at + 2 : at + 2 + k].decode())
            at += 2 + k
        pos, alleles = struct.unpack_from("<IH", data, at)
        at += 6
        for _ in range(alleles):
            (k,) = struct.unpack_from("<I", data, at)
            texts.append(data[at + 4 : at + 4 + k].decode())
            at += 4 + k
        c, d = struct.unpack_from("<II", data, at)
        body = zlib.decompress(data[at + 8 : at + 4 + c])
        assert len(body) == d
        at += 4 + c
        count, k, low, high = struct.unpack_from("<IHBB", body)
        ploidy, phased, bits = body[8 : 8 + count], body[8 + count], body[9 + count]
        assert (count, k, bits) == (n, 2, 8)
        shares, p = [], 10 + count
        for x in ploidy:
            shares.append(tuple(body[p : p + (x & 63)]))
            p += x & 63
        assert p == len(body) and (low, high) == (min(x & 63 for x in ploidy), max(x & 63 for x in ploidy))
        out.append((texts, pos, phased, list(ploidy), shares, begin, at - begin))
    assert len(out) == m
    return names, out


def share(call, phased):
    if -1 in call:
        return (0,) * len(call)
    if len(call) == 1:
        return (255 * (call[0] == 0),)
    return tuple(255 * (a == 0) for a in call) if phased else (255 * (sum(call) == 0), 255 * (sum(call) == 1))


def test_bgen(five, tmp_path, caplog):
    path = tmp_path / "a.bgen"
    with caplog.at_level(logging.WARNING):
        offsets = bgen.write_bgen(five, str(path), str(tmp_path / "a.sample"), str(tmp_path / "a.bgi"))
    assert "1 variant(s) mix" in caplog.text
    names, rows = decoded(path.read_bytes())
    assert names == [f"S{k}" for k in range(6)] and offsets == [r[5] for r in rows] + [path.stat().st_size]
    assert [r[0] for r in rows] == [[".", "rs1", "chr1", "A", "T"], [".", ".", "chrM", "A", "C"], [".", "x", "chrX", "A", "G"], [".", ".", "chrUn", "A", "."], [".", "longer", "7", "A", "TT"]]
    for r, calls, phased in zip(rows, GT, [1, 0, 1, 0, 1], strict=True):
        assert r[2] == phased and r[3] == [len(c) + 128 * (-1 in c) for c in calls] and r[4] == [share(c, phased) for c in calls]
    assert (tmp_path / "a.sample").read_text().splitlines()[:3] == ["ID_1 ID_2 missing", "0 0 0", "S0 S0 0"]
    db = sqlite3.connect(tmp_path / "a.bgi")
    got = db.execute("SELECT chromosome, position, rsid, number_of_alleles, allele1, allele2, file_start_position, size_in_bytes FROM Variant ORDER BY file_start_position").fetchall()
    assert got == [(r[0][2], r[1], r[0][1], 2, r[0][3], r[0][4], r[5], r[6]) for r in rows]
    bgen.write_bgi(five, str(tmp_path / "b.bgi"), offsets)
    assert sqlite3.connect(tmp_path / "b.bgi").execute("SELECT * FROM Variant").fetchall() == db.execute("SELECT * FROM Variant").fetchall()
    parallel = bgen.index_rows(five).orderBy("variant_index").collect()
    assert [(r["start"], r["size"]) for r in parallel] == [(r[5], r[6]) for r in rows]


def test_bgen_options(five, spark, caplog):
    def made_(vs=five, **kw):
        out = io.BytesIO()
        bgen.write_bgen(vs, out, **kw)
        return decoded(out.getvalue())

    names, rows = made_(embed_header_samples=False, unphased=True, variant_id_field="varid", compression_level=9)
    assert names == [] and [r[2] for r in rows] == [0] * 5 and rows[0][0][:2] == ["rs1", "."] and "no sample names" in caplog.text
    assert [r[3] for r in made_(five.with_samples(["S3", "S0"]))[1]][1] == [2, 1]
    for kw, match in (({"total_string_length": 9}, "need fixed"), ({"fixed_variant_size": True, "compression_level": 1}, "level 0"), ({"variant_id_field": "x"}, "rsid"), ({"compression_level": 10}, "levels"), ({"fixed_variant_size": True, "pad_byte": b"\0"}, "padding"), ({"fixed_variant_size": True, "total_string_length": 4}, "budget")):
        with pytest.raises(ValueError, match=match):
            made_(**kw)
    with pytest.raises(Exception, match="one ploidy"):
        made_(fixed_variant_size=True)
    with pytest.raises(Exception, match="allele"):
        made_(made(spark, 1, fixed={"gt": [[[0, 2]]], "phased": [[True]]}))
    with pytest.raises(ValueError, match="white space"):
        bgen.sample_text(("a\tb",))


def test_stored_streams():
    for n in (0, 1, 65535, 65536, 200_000):
        data = bytes(range(256)) * (n // 256) + b"x" * (n % 256)
        assert zlib.decompress(bgen.stored(data)) == data and len(bgen.stored(data)) == bgen.stored_size(n)


@pytest.mark.parametrize("block", [1, 40, 10 << 20])
def test_random_access(diploid, block):
    out = io.BytesIO()
    plink.write_bed(diploid, out)
    bed = out.getvalue()
    out = io.BytesIO()
    offsets = bgen.write_bgen(diploid, out, fixed_variant_size=True, total_string_length=32, pad_byte=b"-")
    fixed = out.getvalue()
    _, rows = decoded(fixed)
    assert len({r[6] for r in rows}) == 1 and rows[1][0][0] == "." + "-" * (31 - 6) and sum(map(len, rows[0][0])) == 32
    with BedEncoder(diploid, block * 2) as a, BgenEncoder(diploid, 32, b"-", block_bytes=block * 130) as b:
        assert (a.total_size, a.bed_size, a.prefix_size, a.bytes_per_variant, a.num_variants, a.num_samples) == (len(bed), len(bed), 3, 2, 50, 7)
        assert b.bgen_size == len(fixed) and list(b.variant_offsets) == offsets
        assert a.try_cached_read(0, 2) == bed[:2] and a.try_cached_read(3, 2) is None
        for whole, enc, places in ((bed, a, [(0, 3), (2, 4), (50, 40), (3, 0), (len(bed) - 1, 99), (len(bed) + 5, 2)]), (fixed, b, [(0, 30), (len(fixed) // 2, 300), (70, 5), (len(fixed) - 3, 9)])):
            for off, size in places:
                assert enc.read(off, size) == whole[off : off + size]
            off, size = places[1]
            assert enc.read(off, size) == whole[off : off + size] and (block < 100 or enc.try_cached_read(off, size) == whole[off : off + size])
        if block > 1:
            out = io.BytesIO()
            assert b.write_to(out, block=777) == len(fixed) and out.getvalue() == fixed
            out = io.BytesIO()
            assert a.write_to(out, 5, 20) == 20 and out.getvalue() == bed[5:25]
        with pytest.raises(ValueError, match="negative"):
            a.read(-1, 2)
    with pytest.raises(RuntimeError, match="closed"):
        a.read(0, 1)
    with pytest.raises(NotImplementedError, match="materialised"):
        BedEncoder(diploid.with_filter("POS > 3"))


def test_haploid_fixed(spark):
    vs = made(spark, 3, fixed={"gt": [[[0], [1]], [[-1], [0]], [[1], [1]]]}, ploidy=1)
    out = io.BytesIO()
    bgen.write_bgen(vs, out, fixed_variant_size=True)
    with BgenEncoder(vs) as enc:
        assert enc.read(0, 10_000) == out.getvalue()
    assert [r[3] for r in decoded(out.getvalue())[1]] == [[1, 1], [129, 1], [1, 1]]


def test_parts(spark, diploid, tmp_path):
    """What executors write in parts is, one after the other, the single file."""
    out = io.BytesIO()
    plink.write_bed(diploid, out)
    plink.write_parts(diploid, str(tmp_path / "p"))
    whole = lambda folder, head: (folder / "head").read_bytes() + b"".join(p.read_bytes() for p in sorted((folder / head).glob("part-*")))
    assert whole(tmp_path / "p", "bed") == out.getvalue() and (tmp_path / "p" / "fam").read_text().splitlines()[6] == "S6\tS6\t0\t0\t0\t-9"
    assert spark.read.text(str(tmp_path / "p" / "bim")).count() == 50 and len(list((tmp_path / "p" / "bed").iterdir())) > 1
    out = io.BytesIO()
    offsets = bgen.write_bgen(diploid, out, compression_level=3)
    bgen.write_parts(diploid, f"file://{tmp_path}/b", bgen.Layout(3))
    assert whole(tmp_path / "b", "blocks") == out.getvalue()
    assert [r["start"] for r in spark.read.parquet(str(tmp_path / "b" / "index")).orderBy("variant_index").collect()] == offsets[:-1]


def test_blocks_of_a_batch():
    """Genotypes of many variants at once are those of each alone, call by call."""
    rng = np.random.default_rng(8)
    calls = rng.integers(-1, 2, (40, 9, 2)).astype(np.int8)
    calls[::3, ::2, 1] = -2
    phased = rng.random(40) < 0.5
    for own, flag, made_ in zip(calls.tolist(), phased, bgen.genotype_blocks(calls, phased), strict=True):
        plain = [[a for a in c if a != -2] for c in own]
        want = struct.pack("<IHBB", 9, 2, min(map(len, plain)), max(map(len, plain))) + bytes(len(c) + 128 * (-1 in c) for c in plain) + bytes([int(flag), 8]) + bytes(x for c in plain for x in share(c, flag))
        assert made_ == want
