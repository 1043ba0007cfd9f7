"""Chunked array stores, the command line, and streams."""

import gzip
import json
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cohort import NAMES, ROWS, tulips

import locuspark
from locuspark import cli
from locuspark.functions.sentinels import is_fill, is_missing, trim_fill
from locuspark.sources import chunks, tables, vcfzarr
from locuspark.sources.opened import open_store
from locuspark.streaming import follow as F

MISS, PAD = np.array([0x7F800001, 0x7F800002], np.uint32).view(np.float32)


def arrays():
    """Five variants of three samples, the second of which has no name."""
    v = ("variants",)
    return {
        "contig_id": (np.array(["1", "2"], object), ("contigs",)), "filter_id": (np.array(["PASS", "low"], object), ("filters",)), "sample_id": (np.array(["a", "", "c"], object), ("samples",)), "region_index": (np.zeros((2, 6), np.int32), ("regions", "fields")),
        "variant_contig": (np.array([0, 0, 0, 1, 1], np.int8), v), "variant_position": (np.array([5, 9, 12, 3, 8], np.int32), v), "variant_length": (np.array([1, 2, 1, 1, 1], np.int32), v), "variant_id": (np.array(["x", ".", "y", ".", "."], object), v),
        "variant_allele": (np.array([["A", "C", ""], ["AG", "A", "T"], ["C", "", ""], ["G", "T", ""], ["T", "G", "C"]], object), (*v, "alleles")), "variant_quality": (np.array([1.5, MISS, 3, np.nan, 5], np.float32), v), "variant_filter": (np.array([[1, 0], [0, 1], [0, 0], [1, 1], [1, 0]], bool), (*v, "filters")),
        "variant_DP": (np.array([3, -1, 5, 6, 7], np.int16), v), "variant_AF": (np.array([[0.5, PAD], [MISS, 0.25], [PAD, PAD], [1, PAD], [0, 0]], np.float32), (*v, "alt_alleles")), "variant_FL": (np.array([1, 0, 0, 1, 0], bool), v), "variant_NM": (np.array(["q", ".", "r", "s", "t"], "U3"), v),
        "call_genotype": (np.array([[[0, 1], [9, 9], [1, 1]], [[0, -2], [9, 9], [-1, -1]], [[0, 0]] * 3, [[1, 0]] * 3, [[2, 1]] * 3], np.int8), (*v, "samples", "ploidy")), "call_genotype_phased": (np.array([[1, 0, 0]] * 5, bool), (*v, "samples")), "call_DP": (np.array([[1, 9, 2], [-1, 9, 4], [5, 9, 6], [7, 9, 8], [9, 9, 10]], np.int32), (*v, "samples")),
        "call_PL": (np.array([[[1, 2], [9, 9], [3, -2]]] * 5, np.int8), (*v, "samples", "FORMAT_PL_dim")), "variant_id_mask": (np.zeros(5, bool), v),
    }


def packed_strings(values, order):
    body = b"".join(struct.pack("<I", len(s.encode())) + s.encode() for s in values.ravel(order))
    return struct.pack("<I", values.size) + body


def blosc(data, width, kind=4, level=3):
    """A blosc container with shuffle, in blocks of 256 bytes."""
    import zstandard

    size, out, starts, block = len(data), [], [], 256 * width
    at = 16 + 4 * max(1, -(-size // block))
    for k in range(0, size, block):
        part = data[k : k + block]
        if width > 1:
            n = len(part) // width
            part = np.frombuffer(part, np.uint8, n * width).reshape(n, width).T.tobytes() + part[n * width :]
        split = width <= 16 and len(part) == block
        starts.append(at)
        for s in range(width if split else 1):
            own = part[s * 256 : (s + 1) * 256] if split else part
            small = {4: lambda x: zstandard.compress(x, level), 3: zlib.compress, 1: lambda x: pa.Codec("lz4_raw").compress(x, asbytes=True)}[kind](own)
            small = own if len(small) >= len(own) else small
            out.append(struct.pack("<i", len(small)) + small)
            at += 4 + len(small)
    return struct.pack("<BBBBIII", 2, 1, 1 | kind << 5, width, size, block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(out)


def store(root, third=False, codec="zlib", step=2, order="C", endian="<"):
    """Writes :func:`arrays` as a chunked store."""
    import itertools

    root.mkdir()
    attrs = {"source": "test", "vcf_meta_information": [["fileDate", "2024"]]}
    (root / ("zarr.json" if third else ".zgroup")).write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attrs} if third else {"zarr_format": 2}))
    if not third:
        (root / ".zattrs").write_text(json.dumps(attrs))
    for name, (values, dims) in arrays().items():
        shape = values.shape
        size = tuple(step * (2 if name == "variant_DP" else 1) if d == "variants" else 2 if d == "samples" and name.startswith("call") else max(1, s) for d, s in zip(dims, shape, strict=True))
        text = values.dtype == object
        if not text and values.dtype.kind in "ifU":
            values = values.astype(values.dtype.newbyteorder(endian))
        folder = root / name
        folder.mkdir()
        if third:
            kind = "string" if text else {"name": "fixed_length_utf32", "configuration": {"length_bytes": 12}} if values.dtype.kind == "U" else values.dtype.name
            inner = [{"name": "vlen-utf8"}] if text else [{"name": "bytes", "configuration": {"endian": "little" if endian == "<" else "big"}}]
            (folder / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": size}}, "chunk_key_encoding": {"name": "default"}, "fill_value": "" if text else 0, "codecs": [*inner, {"name": codec}], "dimension_names": dims}))
        else:
            about = {"zarr_format": 2, "shape": shape, "chunks": size, "dtype": "|O" if text else values.dtype.str, "order": order, "fill_value": None, "filters": [{"id": "vlen-utf8"}] if text else None, "compressor": {"id": codec} if codec else None}
            (folder / ".zarray").write_text(json.dumps(about))
            (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, "description": f"about {name}"}))
        for index in itertools.product(*(range(-(-s // c)) for s, c in zip(shape, size, strict=True))):
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, size, strict=True))]
            full = np.full(size, "" if text else 0, values.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            data = packed_strings(full, order) if text else full.tobytes(order)
            width = 1 if text else full.dtype.itemsize
            import zstandard

            data = {"zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.compress, None: bytes, "blosc": lambda d, w=width: blosc(d, w), "lz4": lambda d: struct.pack("<i", len(d)) + pa.Codec("lz4_raw").compress(d, asbytes=True)}[codec](data)
            place = folder / ("/".join(["c", *map(str, index)]) if third else ".".join(map(str, index)))
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(data)


def rows(vs):
    return [r.asDict() for r in vs.df.orderBy("variant_index").collect()]


@pytest.fixture(scope="module")
def plain_store(tmp_path_factory):
    path = tmp_path_factory.mktemp("stores") / "a.zarr"
    store(path)
    return path


def test_values(spark, plain_store):
    vs = open_store(spark, str(plain_store))
    assert (vs.sample_ids, vs.contigs, vs.filters, vs.max_alleles, vs.ploidy, vs.source, vs.meta) == (("a", "c"), ("1", "2"), ("PASS", "low"), 3, 2, "test", (("fileDate", "2024"),))
    got = rows(vs)
    assert [r["variant_index"] for r in got] == list(range(5)) and [(r["chrom"], r["pos"], r["rlen"]) for r in got] == [("1", 5, 1), ("1", 9, 2), ("1", 12, 1), ("2", 3, 1), ("2", 8, 1)]
    assert [r["alts"] for r in got] == [["C"], ["A", "T"], [], ["T"], ["G", "C"]] and [r["id"] for r in got] == ["x", None, "y", None, None] and [r["filters"] for r in got] == [["PASS"], ["low"], [], ["PASS", "low"], ["PASS"]]
    assert [r["qual"] for r in got][:3] == [1.5, None, 3.0] and np.isnan(got[3]["qual"])
    assert [r["info_DP"] for r in got] == [3, None, 5, 6, 7] and [r["info_AF"] for r in got] == [[0.5], [None, 0.25], [], [1.0], [0.0, 0.0]] and [r["info_FL"] for r in got] == [True, False, False, True, False] and [r["info_NM"] for r in got] == ["q", None, "r", "s", "t"]
    assert [r["gt"] for r in got] == [[[0, 1], [1, 1]], [[0], [None, None]], [[0, 0]] * 2, [[1, 0]] * 2, [[2, 1]] * 2] and got[0]["phased"] == [True, False] and [r["fmt_DP"] for r in got] == [[1, 2], [None, 4], [5, 6], [7, 8], [9, 10]] and got[0]["fmt_PL"] == [[1, 2], [3]]
    about = {f.column: f for f in vs.fields}
    assert (about["info_AF"].number, about["info_FL"].number, about["fmt_PL"].number, about["fmt_PL"].width, about["info_DP"].description) == ("A", "0", "2", 2, "about variant_DP") and "info_id_mask" not in about


@pytest.mark.parametrize(("third", "codec", "order", "endian"), [(False, None, "F", ">"), (False, "blosc", "C", "<"), (False, "lz4", "C", "<"), (True, "zstd", "C", "<"), (True, "gzip", "C", ">")])
def test_formats_agree(spark, plain_store, tmp_path, third, codec, order, endian):
    store(tmp_path / "b", third, codec, 2, order, endian)
    want, got = vcfzarr.Store(str(plain_store)).batch(0, 5), vcfzarr.Store(str(tmp_path / "b")).batch(0, 5)
    drop = [k for k, f in enumerate(want.schema) if f.name != "qual"]
    assert got.select(drop).equals(want.select(drop)) and str(got.column("qual")) == str(want.column("qual"))


def test_zip_urls_and_pruning(spark, plain_store, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zarr.zip", "w") as z:
        for f in plain_store.rglob("*"):
            if f.is_file():
                z.write(f, f.relative_to(plain_store))
    assert str(rows(open_store(spark, str(tmp_path / "a.zarr.zip")))) == str(rows(open_store(spark, str(plain_store))))
    few = open_store(spark, plain_store.as_uri(), "fsspec", fields=["INFO/DP", "GT"])
    assert {"info_DP", "gt"} <= set(few.df.columns) and "fmt_DP" not in few.df.columns and [r["info_DP"] for r in rows(few)] == [3, None, 5, 6, 7]
    for args, error in ((("x://y",), ValueError), ((str(plain_store), "other"), ValueError), ((str(plain_store), "icechunk"), NotImplementedError), ((str(plain_store), None, {"a": 1}), ValueError)):
        with pytest.raises(error):
            chunks.Files(*args)
    with pytest.raises(FileNotFoundError):
        vcfzarr.Store(str(tmp_path))


def test_blosc_streams():
    rng = np.random.default_rng(1)
    for width, n in ((1, 10), (4, 3000), (8, 2048), (2, 777)):
        data = rng.integers(0, 5, n).astype(f"i{width}").tobytes()
        for kind in (1, 3, 4):
            assert chunks._unblosc(blosc(data, width, kind)) == data


def test_sentinels():
    assert is_missing(np.array([1, -1, -2])).tolist() == [False, True, False] and is_fill(np.array([1, -1, -2])).tolist() == [False, False, True]
    marks = np.array([0x7F800001, 0x7F800002, 0x7FC00000], np.uint32).view(np.float32)
    assert is_missing(marks).tolist() == [True, False, False] and is_fill(marks).tolist() == [False, True, False]
    assert is_missing(np.array(["a", ".", ""])).tolist() == [False, True, False] and is_missing(np.array([True, False])).tolist() == [False, True]
    assert trim_fill(np.array([1, -2, 3, -2, -2])).tolist() == [1, -2, 3] and trim_fill(np.array([-2, -2])).tolist() == []
    half = np.array([0x7C01, 0x7C02, 0x3C00], np.uint16).view(np.float16)
    assert is_missing(half).tolist() == [True, False, False]


# --- command line -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sets") / "ten")
    tables.write(tulips(spark), path)
    return path


def run(spark, capsys, *argv):
    code = cli.main([str(a) for a in argv], spark)
    got = capsys.readouterr()
    return code, got.out, got.err


def test_commands(spark, kept, capsys, tmp_path):
    assert run(spark, capsys, "index", "-n", kept)[1] == f"{len(ROWS)}\n"
    assert run(spark, capsys, "index", "-s", kept)[1] == "".join(f"{c}\t.\t{sum(r[0] == c for r in ROWS)}\n" for c in ("chr3", "chr8", "chrY"))
    assert run(spark, capsys, "index", kept)[0] == 2 and run(spark, capsys, "index", "-n", "-s", kept)[0] == 2
    assert run(spark, capsys, "query", "-l", kept)[1] == "".join(f"{n}\n" for n in NAMES)
    assert run(spark, capsys, "query", kept)[0] == 2
    assert run(spark, capsys, "query", "-f", "%POS[ %TD]", "-r", "chr8:1-400", "-s", "^bo,dee", kept)[1] == "".join(f"{r[1]} {r[8]['td'][0]} {r[8]['td'][2]}\n" for r in ROWS if r[0] == "chr8" and r[1] <= 400)
    code, out, _ = run(spark, capsys, "view", "-H", "-s", "dee,ana", "-i", "INFO/TD > 20", "-M", "2", "-v", "snps", kept)
    assert code == 0 and [line.split("\t")[1] for line in out.splitlines()] == ["40", "7", "352"] and out.startswith("chr3\t40\ttul1\tG\tC\t12.5\tPASS\tAC=0;AN=4;CNT=2,.;NOV;ORI=field;PF=0.25,.;TD=21\tGT:QL:RR:TD\t0/0:8:7,8:2\t0|0:30:1,2:6\n")
    assert run(spark, capsys, "view", "-h", "--no-version", "-G", kept)[1].endswith("FILTER\tINFO\n")
    assert run(spark, capsys, "query", "-i", "TD > 3", "-f", "%POS", kept)[2].startswith("Error: ambiguous")
    wrong = "-r chr3 -R f, -i POS>1 -e POS>1, -G -s ana, -G --fill-tags AC, -I --fill-tags AC, --fill-tags MAF, -s ^" + "+".join(NAMES) + ", -o x.bcf, -v snps -V snps, -v refs, -G -i FMT/TD>1"
    for extra in wrong.split(", "):
        code, _, err = run(spark, capsys, "view", *(x.replace("+", ",") for x in extra.split()), kept)
        assert code == 1 and err.startswith("Error"), extra
    path = tmp_path / "out.vcf"
    assert run(spark, capsys, "view", "--no-version", "-o", path, kept)[0] == 0
    assert run(spark, capsys, "query", "-f", "%POS", path)[1].split() == [str(r[1]) for r in ROWS]


def test_exports(spark, kept, capsys, tmp_path):
    stem, two = tmp_path / "p", sum(len(r[4]) <= 1 for r in ROWS)
    assert run(spark, capsys, "view-plink", "-o", stem, kept)[0] != 0
    assert run(spark, capsys, "view-plink", "-o", stem, "-M", "2", "-s", "cyd,ana", kept)[0] == 0
    assert (tmp_path / "p.fam").read_text().startswith("cyd") and len((tmp_path / "p.bim").read_text().splitlines()) == two
    diploid = ["-M", "2", "-r", "chr3,chr8"]
    assert run(spark, capsys, "view-bgen", "-o", stem, *diploid, "--no-bgi", "--fixed-variant-size", "--pad-byte", "-", kept)[0] == 0
    assert (tmp_path / "p.bgen").read_bytes()[16:20] == b"bgen" and (tmp_path / "p.sample").exists() and not (tmp_path / "p.bgen.bgi").exists()
    opts = cli.ViewBgenOptions(selection=cli.SelectionOptions(max_alleles=2))
    assert opts.variants(spark, kept).num_variants() == two


def test_reader_options(spark, kept, capsys):
    """Reader options are Spark settings while a command runs, and only then."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before, seen = [spark.conf.get(n, None) for n in names], []
    count = cli.stats.write_count
    try:
        cli.stats.write_count = lambda vs, out: (seen.append([spark.conf.get(n, None) for n in names]), count(vs, out))
        assert run(spark, capsys, "index", "-n", "--readahead-workers", "3", "--readahead-buffer-size", "2MiB", "--encode-threads", "5", kept)[:2] == (0, f"{len(ROWS)}\n")
        assert run(spark, capsys, "index", "-n", "--encode-threads", "0", kept)[0] == 1
    finally:
        cli.stats.write_count = count
    assert seen == [["3", str(2 << 20), "5"]] and [spark.conf.get(n, None) for n in names] == before
    assert [cli.byte_size(t) for t in ("7", "100M", "2G", "256MiB", "1kb", "8B")] == [7, 100 << 20, 2 << 30, 256 << 20, 1024, 8]
    for bad in ("0", "x", "-3", "1.5M"):
        with pytest.raises(Exception, match="size"):
            cli.byte_size(bad)


def test_storage_options():
    assert cli.storage_options(["a=1", "b=x", "c={\"d\": true}"]) == {"a": 1, "b": "x", "c": {"d": True}}
    with pytest.raises(cli.UsageError):
        cli.storage_options(["a"])


def test_public_names():
    for name in locuspark.__all__:
        assert getattr(locuspark, name) is not None
    with pytest.raises(AttributeError):
        locuspark.nothing  # noqa: B018


# --- streams ------------------------------------------------------------------------------
def test_stream(spark, kept, tmp_path):
    from locuspark.plans.formats import formatted

    vs = F.follow(spark, kept).with_samples(["cyd"]).with_filter("FMT/TD > 3")
    query = F.append(formatted(vs, "%POS[ %TD]"), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(120)
    reads = [(r[1], r[8].get("td", [-1] * 4)[2]) for r in ROWS]
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"{p} {x}\n" for p, x in reads if x > 3)


# --- pruned reads -------------------------------------------------------------------------
def wide(root, rows=24, samples=10, step=4, block=3):
    """A store of format 2 with several chunks of variants and of samples, and its region index."""
    rng = np.random.default_rng(2)
    pos = np.sort(rng.integers(1, 500, rows)).astype(np.int32)
    contig = (np.arange(rows) >= rows // 2).astype(np.int8)
    length = np.where(np.arange(rows) % 7 == 0, 90, 1).astype(np.int32)
    index = []
    for k in range(rows // step):
        for c in (0, 1):
            own = np.flatnonzero(contig[k * step : (k + 1) * step] == c) + k * step
            if len(own):
                index.append([k, c, pos[own[0]], pos[own[-1]], (pos[own] + length[own] - 1).max(), len(own)])
    v = ["variants"]
    text = lambda *x: np.array(x, object)
    data = {
        "contig_id": (text("one", "two"), ["contigs"]), "filter_id": (text("PASS"), ["filters"]), "sample_id": (text(*(f"s{k}" for k in range(samples))), ["samples"]), "region_index": (np.array(index, np.int32), ["regions", "fields"]), "variant_contig": (contig, v), "variant_position": (pos, v), "variant_length": (length, v),
        "variant_allele": (text(*[["A", "C"]] * rows), [*v, "alleles"]), "variant_id": (text(*(f"v{k}" for k in range(rows))), v), "variant_DP": (rng.integers(0, 50, rows).astype(np.int32), v), "call_genotype": (rng.integers(0, 2, (rows, samples, 2)).astype(np.int8), [*v, "samples", "ploidy"]), "call_genotype_phased": (rng.random((rows, samples)) < 0.5, [*v, "samples"]),
        "call_DP": (rng.integers(0, 30, (rows, samples)).astype(np.int16), [*v, "samples"]), "call_GQ": (rng.integers(0, 99, (rows, samples)).astype(np.int16), [*v, "samples"]),
    }
    root.mkdir()
    (root / ".zgroup").write_text('{"zarr_format": 2}')
    for name, (values, dims) in data.items():
        size = [step if d == "variants" else block if d == "samples" and name.startswith("call") else n for d, n in zip(dims, values.shape, strict=True)]
        (root / name).mkdir()
        is_text = values.dtype == object
        (root / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": values.shape, "chunks": size, "dtype": values.dtype.str, "order": "C", "fill_value": None, "filters": [{"id": "vlen-utf8"}] if is_text else None, "compressor": None}))
        (root / name / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims}))
        for place in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, size, strict=True))):
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(place, size, strict=True))]
            full = np.full(size, "" if is_text else 0, values.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            (root / name / ".".join(map(str, place))).write_bytes(packed_strings(full, "C") if is_text else full.tobytes())
    return data


@pytest.fixture(scope="module")
def wide_store(tmp_path_factory):
    path = tmp_path_factory.mktemp("wide") / "w.zarr"
    return path, wide(path)


def asked(df):
    """The options of the scan of a frame."""
    from pyspark.sql import DataFrame

    assert isinstance(df, DataFrame)
    return df._jdf.queryExecution().analyzed().toString()


def test_reads_of_chunks(wide_store, monkeypatch):
    """Only the chunks of the wanted columns, blocks and rows are read."""
    path, _ = wide_store
    s = vcfzarr.Store(str(path))
    assert s.block == 3 and [f.name for f in s.schema() if f.name.startswith("gt")] == [f"gt__{k}" for k in range(4)]
    seen = []
    real = chunks.Files.get
    monkeypatch.setattr(chunks.Files, "get", lambda self, name: (seen.append(name), real(self, name))[1])
    reader = vcfzarr._Reader(s, frozenset(["variant_index", "pos", "gt__2", "fmt_DP__0"]), frozenset([1, 3]))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sorted(seen) == sorted([f"variant_position/{k}" for k in (1, 3)] + [f"call_genotype/{k}.2.0" for k in (1, 3)] + [f"call_DP/{k}.0" for k in (1, 3)])
    assert [b.num_rows for b in batches] == [4, 4] and batches[1].column("variant_index").to_pylist() == [12, 13, 14, 15]
    assert reader.partitions()[0].value == (1,) and vcfzarr._ranges(frozenset([0, 1, 2, 5])) == [[0, 3], [5, 6]]


def test_queries_over_blocks(spark, wide_store):
    """Queries give what the arrays hold, and ask the store for nothing else."""
    path, data = wide_store
    vs = open_store(spark, str(path))
    pos, contig, last = data["variant_position"][0], data["variant_contig"][0], data["variant_position"][0] + data["variant_length"][0] - 1
    gt, dp, gq, site = (data[n][0] for n in ("call_genotype", "call_DP", "call_GQ", "variant_DP"))
    scans = []
    frame = vcfzarr.StoreScan.frame
    vcfzarr.StoreScan.frame = lambda self, columns, kept: (scans.append((columns, kept)), frame(self, columns, kept))[1]
    try:
        from locuspark.plans.formats import formatted
        from locuspark.plans.resolve import project

        part = vs.with_samples(["s7", "s1"]).with_regions("two:100-300")
        hit = [k for k in range(24) if contig[k] == 1 and last[k] >= 100 and pos[k] <= 300]
        got = project(part, ["POS", "GT", "FORMAT/DP"]).orderBy("variant_index").collect()
        assert [(r["pos"], r["gt"], r["fmt_DP"]) for r in got] == [(pos[k], gt[k][[7, 1]].tolist(), dp[k][[7, 1]].tolist()) for k in hit]
        columns, kept = scans[-1]
        assert columns == {"variant_index", "chrom", "pos", "rlen", *(f"{c}__{k}" for c in ("gt", "phased", "fmt_DP") for k in (0, 2))}
        assert kept == {k for k in range(6) if any(contig[i] == 1 and pos[4 * k : 4 * k + 4].min() <= 300 for i in range(4 * k, 4 * k + 4))} & {k for k in range(6) if (last[4 * k : 4 * k + 4][contig[4 * k : 4 * k + 4] == 1] >= 100).any()}
        text = formatted(vs.with_filter("INFO/DP > 20").with_variants(range(4, 12)), "%ID %POS\\n").orderBy("variant_index").collect()
        assert [r["text"] for r in text] == [f"v{k} {pos[k]}\n" for k in range(4, 12) if site[k] > 20]
        assert scans[-1] == ({"variant_index", "chrom", "pos", "rlen", "id", "info_DP"}, {1, 2})
        trusted = formatted(vs.with_filter("FMT/GQ > 90"), "%POS[ %SAMPLE]").orderBy("variant_index").collect()
        assert [r["text"] for r in trusted] == [" ".join([str(pos[k]), *(f"s{i}" for i in np.flatnonzero(gq[k] > 90))]) + "\n" for k in range(24) if (gq[k] > 90).any()]
        assert scans[-1][0] == {"variant_index", "chrom", "pos", "rlen", *(f"fmt_GQ__{k}" for k in range(4))}
        viewed = vs.with_samples(["s4"]).with_mode("bcftools", view=True).with_filter("FMT/GQ > 90")
        assert project(viewed, ["GT"]).count() == (gq > 90).any(axis=1).sum() and any(c.startswith("fmt_GQ__3") for c in scans[-1][0])
        assert vs.starting_at(17).num_variants() == 7 and scans[-1] == ({"variant_index", "chrom", "pos", "rlen"}, {4, 5})
        assert vs.with_targets("one").num_variants() == 12 and scans[-1][1] == {0, 1, 2} and vs.with_targets("one", True).num_variants() == 12
        kept_rows = vs.with_filter("INFO/DP > 20").materialised()
        assert project(kept_rows, ["GT"]).count() == (site > 20).sum() and "info_DP" in scans[-1][0] and "id" not in scans[-1][0]
        alleles = project(vs.with_samples(["s2", "s9"]), ["AC"]).orderBy("variant_index").collect()
        assert [r["info_AC"] for r in alleles] == [[int(gt[k][[2, 9]].sum())] for k in range(24)]
    finally:
        vcfzarr.StoreScan.frame = frame


def test_whole_output_of_a_pruned_store(spark, wide_store, capsys, tmp_path):
    """The command line over a store: VCF text, PLINK and BGEN are those of the same set as Parquet."""
    path, _ = wide_store
    vs = open_store(spark, str(path))
    tables.write(vs, str(tmp_path / "set"))
    for args in (("view", "--no-version", "-s", "s8,s0", "-r", "one"), ("query", "-f", "%POS %ID[ %GT:%DP]", "-i", "FMT/DP > 20"), ("index", "-s")):
        assert run(spark, capsys, *args, path)[:2] == run(spark, capsys, *args, tmp_path / "set")[:2]
    for command, ends in (("view-plink", ("bed", "bim", "fam")), ("view-bgen", ("bgen", "sample"))):
        for name, source in (("a", path), ("b", tmp_path / "set")):
            assert run(spark, capsys, command, "-o", tmp_path / name, "-i", "INFO/DP > 10", source)[0] == 0
        for end in ends:
            assert (tmp_path / f"a.{end}").read_bytes() == (tmp_path / f"b.{end}").read_bytes()


def test_bit_planes():
    """A block of bit planes, made bit by bit."""
    rng = np.random.default_rng(3)
    for width, n in ((1, 64), (2, 40), (4, 8), (8, 24), (4, 7), (2, 9)):
        data = rng.integers(0, 256, width * n).astype(np.uint8).tobytes() + b"xyz"[: width - 1]
        planes = bytearray()
        if n % 8 == 0:
            for byte in range(width):
                for bit in range(8):
                    for k in range(0, n, 8):
                        planes.append(sum((data[(k + i) * width + byte] >> bit & 1) << i for i in range(8)))
            planes += data[width * n :]
        body = bytes(planes) if n % 8 == 0 else data
        packed = struct.pack("<BBBBIII", 2, 1, 4 | 16 | 3 << 5, width, len(data), len(data), 0) + struct.pack("<i", 20)
        small = zlib.compress(body)
        assert chunks._unblosc(packed + struct.pack("<i", len(small)) + small) == data


@pytest.mark.parametrize("leads", [False, True])
@pytest.mark.parametrize("checked", [False, True])
def test_shards(tmp_path, leads, checked):
    """A shard holds its chunks in any order behind or before an index; chunks may be left out."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 99, (5, 6)).astype("<i4")
    (tmp_path / "x" / "c" / "0").mkdir(parents=True)
    (tmp_path / "x" / "c" / "1").mkdir(parents=True)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": "crc32c"}] if checked else [])]
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}], "index_codecs": codecs, "index_location": "start" if leads else "end"}}
    (tmp_path / "x" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [5, 6], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 6]}}, "chunk_key_encoding": {"name": "default"}, "fill_value": 7, "codecs": [shard], "dimension_names": ["a", "b"]}))
    (tmp_path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}))
    import zstandard

    values[0:2, 3:6] = 7  # never written
    full = np.full((8, 6), 7, "<i4")
    full[:5] = values
    for row in (0, 1):
        index, body = np.full((4, 2), (1 << 64) - 1, np.uint64), b""
        start = 64 + 4 * checked if leads else 0
        for k in (3, 0, 2, 1):
            i, j = divmod(k, 2)
            part = full[4 * row + 2 * i : 4 * row + 2 * i + 2, 3 * j : 3 * j + 3]
            if (part != 7).any():
                own = zstandard.compress(part.tobytes())
                index[k] = start + len(body), len(own)
                body += own
        table = index.tobytes() + b"\0" * (4 * checked)
        (tmp_path / "x" / "c" / str(row) / "0").write_bytes(table + body if leads else body + table)
    files = chunks.Files(str(tmp_path))
    found, _ = chunks.arrays(files)
    assert (found["x"].whole(files) == values).all() and (found["x"].rows(files, 3, 5) == values[3:5]).all()
