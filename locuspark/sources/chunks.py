"""Chunked N-d arrays on a file system or in a zip file: metadata and decoding, formats 2 and 3.

Codecs: none, zlib, gzip, bz2, lzma, zstd, lz4 and the blosc container around
zlib, zstd and lz4 (written from its public description; byte, bit and no
shuffle). Shards of format 3 are read whole, chunk by chunk.
"""

from __future__ import annotations

import bz2
import gzip
import itertools
import json
import lzma
import struct
import zipfile
import zlib
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs


class Files:
    """Read-only files below a folder, a URL or a zip file; picklable, opened where it is used."""

    def __init__(self, path: str, backend: str | None = None, options: dict | None = None):
        if backend == "icechunk":
            raise NotImplementedError("transactional repositories need a client library that is not installed")
        if backend not in (None, "fsspec", "obstore"):
            raise ValueError(f"unknown storage backend {backend!r}")
        url = "://" in str(path)
        if backend is None and url:
            raise ValueError(f"the URL {path!r} needs a storage backend")
        if backend is None and options:
            raise ValueError("storage options are for remote storage")
        self.path, self.options, self.url = str(path), dict(options or {}), url
        self._open: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _store(self):
        if self._open is None:
            if not self.url:
                system, root = pa.fs.LocalFileSystem(), self.path
            elif self.options and urlsplit(self.path).scheme == "s3":
                parts = urlsplit(self.path)
                system, root = pa.fs.S3FileSystem(**self.options), parts.netloc + parts.path
            else:
                system, root = pa.fs.FileSystem.from_uri(self.path)
            archive = zipfile.ZipFile(system.open_input_file(root)) if root.endswith(".zip") else None
            self._open = (system, root.rstrip("/"), archive)
        return self._open

    def get(self, name: str) -> bytes | None:
        system, root, archive = self._store()
        try:
            if archive is not None:
                return archive.read(name)
            with system.open_input_file(f"{root}/{name}") as f:
                return f.readall()
        except (FileNotFoundError, KeyError):
            return None

    def json(self, name: str) -> dict | None:
        data = self.get(name)
        return None if data is None else json.loads(data)

    def folders(self) -> list[str]:
        system, root, archive = self._store()
        if archive is not None:
            return sorted({n.split("/")[0] for n in archive.namelist() if "/" in n})
        found = system.get_file_info(pa.fs.FileSelector(root))
        return sorted(f.base_name for f in found if f.type == pa.fs.FileType.Directory)


# --- codecs -----------------------------------------------------------------------
def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _lz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def _unblosc(data: bytes) -> bytes:
    """The blosc container: a 16-byte head, where each block starts, and blocks of one or ``width`` streams."""
    _, _, flags, width, size, block, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:  # plain copy
        return data[16 : 16 + size]
    kind = flags >> 5
    if kind not in (1, 3, 4):
        raise NotImplementedError(f"inner codec {kind}")
    count = -(-size // block)
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{count}i", data, 16)):
        own = min(block, size - k * block)
        split = not flags & 16 and width <= 16 and block // width >= 128 and own == block
        each = own // width if split else own
        parts = []
        for _ in range(width if split else 1):
            (n,) = struct.unpack_from("<i", data, at)
            part = data[at + 4 : at + 4 + n]
            at += 4 + n
            parts.append(part if n == each else {1: lambda p, e=each: _lz4(p, e), 3: zlib.decompress, 4: _zstd}[kind](part))
        body = b"".join(parts)
        if flags & 4:
            body = _unbitshuffled(body, width)
        elif flags & 1 and width > 1:
            n = own // width
            whole = np.frombuffer(body, np.uint8, n * width).reshape(width, n).T.tobytes()
            body = whole + body[n * width :]
        out.append(body)
    return b"".join(out)


def _unbitshuffled(body: bytes, width: int) -> bytes:
    """A block from its bit planes: those of the first byte of each element, low bit first, then of the next byte."""
    n = len(body) // width
    if n % 8 or not n:
        return body
    planes = np.frombuffer(body, np.uint8, n * width).reshape(width, 8, n // 8)
    bits = np.unpackbits(planes, axis=2, bitorder="little")
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").tobytes() + body[n * width :]


def _decompressed(data: bytes, codec: dict) -> bytes:
    name = codec.get("id") or codec.get("name")
    simple = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": _zstd, "blosc": _unblosc, "crc32c": lambda d: d[:-4]}
    if name in simple:
        return simple[name](data)
    if name == "lz4":
        return _lz4(data[4:], struct.unpack("<i", data[:4])[0])
    raise NotImplementedError(f"codec {name!r}")


def _strings(data: bytes) -> np.ndarray:
    """Length-prefixed UTF-8 strings behind their number."""
    (n,) = struct.unpack_from("<I", data)
    out, at = np.empty(n, object), 4
    for k in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        out[k] = data[at + 4 : at + 4 + size].decode()
        at += 4 + size
    return out


# --- arrays -----------------------------------------------------------------------
@dataclass
class ChunkedArray:
    """One array: shape, chunks, and how a chunk becomes values."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    dims: tuple[str, ...]
    fill: object
    key: str
    codecs: list[dict] = field(default_factory=list)
    strings: bool = False
    order: str = "C"
    attrs: dict = field(default_factory=dict)
    #: The array inside a shard, the number of bytes of checksum behind its index, and whether that stands first.
    inner: ChunkedArray | None = None
    check: int = 0
    leads: bool = False

    def chunk(self, files: Files, index: tuple[int, ...]) -> np.ndarray:
        """A chunk, cut at the edge of the array; one that was never written holds the fill value."""
        shape = tuple(min(c, s - i * c) for i, c, s in zip(index, self.chunks, self.shape, strict=True))
        data = files.get(f"{self.name}/{self.key.format(*index) if self.key else _joined_key(index)}")
        if data is None:
            empty = "" if self.strings or self.dtype.kind in "UO" else 0
            return np.full(shape, empty if self.fill is None else self.fill, object if self.strings else self.dtype)
        if self.inner is not None:
            return self._shard(data)[tuple(slice(0, n) for n in shape)]
        return self._values(data)[tuple(slice(0, n) for n in shape)]

    def _values(self, data: bytes) -> np.ndarray:
        for codec in self.codecs:
            data = _decompressed(data, codec)
        values = _strings(data) if self.strings else np.frombuffer(data, self.dtype)
        return values.reshape(self.chunks, order=self.order)

    def _shard(self, data: bytes) -> np.ndarray:
        """A whole shard: an index of (where, how long) for each inner chunk says where it lies."""
        part = self.inner
        grid = [n // c for n, c in zip(self.chunks, part.chunks, strict=True)]
        size = 16 * int(np.prod(grid))
        at = 0 if self.leads else len(data) - size - self.check
        index = np.frombuffer(data, "<u8", size // 8, at).reshape(-1, 2)
        empty = "" if part.strings or part.dtype.kind in "UO" else 0
        out = np.full(self.chunks, empty if self.fill is None else self.fill, object if part.strings else part.dtype)
        for place, (start, length) in zip(itertools.product(*map(range, grid)), index.tolist(), strict=True):
            if start != (1 << 64) - 1:
                out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(place, part.chunks, strict=True))] = part._values(data[start : start + length])
        return out

    def rows(self, files: Files, a: int, b: int, block: int | None = None) -> np.ndarray:
        """Rows ``a`` to ``b`` of the first axis, the other axes whole; ``block``: only that run of chunks of the second axis."""
        step = self.chunks[0]
        grids = [range(-(-s // c)) for s, c in zip(self.shape[1:], self.chunks[1:], strict=True)]
        wide = list(self.shape[1:])
        if block is not None:
            grids[0], wide[0] = range(block, block + 1), min(self.chunks[1], self.shape[1] - block * self.chunks[1])
        first = 0 if block is None else block
        out = np.empty((b - a, *wide), object if self.strings else self.dtype.newbyteorder("="))
        for i in range(a // step, -(-b // step)):
            low, high = max(a, i * step), min(b, (i + 1) * step)
            for rest in itertools.product(*grids):
                part = self.chunk(files, (i, *rest))
                place = tuple(slice((k - first * (axis == 0)) * c, (k - first * (axis == 0)) * c + n) for axis, (k, c, n) in enumerate(zip(rest, self.chunks[1:], part.shape[1:], strict=True)))
                out[(slice(low - a, high - a), *place)] = part[low - i * step : high - i * step]
        return out

    def whole(self, files: Files) -> np.ndarray:
        return self.rows(files, 0, self.shape[0])


def _joined_key(index: tuple[int, ...]) -> str:
    return ".".join(map(str, index)) or "0"


def _second(name: str, meta: dict, attrs: dict) -> ChunkedArray:
    """Metadata of format 2."""
    filters = [f["id"] for f in meta.get("filters") or []]
    text = filters == ["vlen-utf8"]
    if filters and not text:
        raise NotImplementedError(f"filters {filters} of {name}")
    codecs = [meta["compressor"]] if meta.get("compressor") else []
    sep = meta.get("dimension_separator", ".")
    return ChunkedArray(name, tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"]), tuple(attrs.get("_ARRAY_DIMENSIONS", ())), _fill(meta.get("fill_value"), text), sep.join(["{}"] * len(meta["shape"])) or "0", codecs, text, meta.get("order", "C"), attrs)


def _third(name: str, meta: dict) -> ChunkedArray:
    """Metadata of format 3."""
    grid, keys = meta["chunk_grid"], meta.get("chunk_key_encoding", {"name": "default"})
    if grid["name"] != "regular":
        raise NotImplementedError(f"chunk grid of {name}")
    second = keys["name"] == "v2"
    sep = keys.get("configuration", {}).get("separator", "." if second else "/")
    places = ["{}"] * len(meta["shape"])
    key = (sep.join(places) or "0") if second else sep.join(["c", *places])
    attrs = meta.get("attributes", {})
    dims = tuple(meta.get("dimension_names") or attrs.get("_ARRAY_DIMENSIONS", ()))
    chunks, codecs = tuple(grid["configuration"]["chunk_shape"]), list(meta["codecs"])
    if codecs[0]["name"] != "sharding_indexed":
        return _decoder(name, meta, chunks, codecs, dims, key, attrs)
    about = codecs[0]["configuration"]
    inner = _decoder(name, meta, tuple(about["chunk_shape"]), list(about["codecs"]), dims, "", {})
    index = [c["name"] for c in about.get("index_codecs", [{"name": "bytes"}, {"name": "crc32c"}])]
    if len(codecs) > 1 or index not in (["bytes"], ["bytes", "crc32c"]):
        raise NotImplementedError(f"shards of {name} with codecs {[c['name'] for c in codecs[1:]]} and an index of {index}")
    return ChunkedArray(name, inner.shape, chunks, inner.dtype, dims, inner.fill, key, [], inner.strings, "C", attrs, inner, 4 * (len(index) - 1), about.get("index_location", "end") == "start")


def _decoder(name: str, meta: dict, chunks: tuple[int, ...], codecs: list[dict], dims: tuple[str, ...], key: str, attrs: dict) -> ChunkedArray:
    """An array of format 3 whose chunks have these codecs."""
    kind = meta["data_type"]
    about = kind.get("configuration", {}) if isinstance(kind, dict) else {}
    kind = kind["name"] if isinstance(kind, dict) else kind
    text = kind == "string"
    first = codecs.pop(0)
    order = "C"
    if first["name"] == "transpose":
        if list(first["configuration"]["order"]) != list(range(len(meta["shape"])))[::-1]:
            raise NotImplementedError(f"axis order of {name}")
        order, first = "F", codecs.pop(0)
    if first["name"] not in ("bytes", "vlen-utf8"):
        raise NotImplementedError(f"codec {first['name']!r} of {name}")
    end = ">" if first.get("configuration", {}).get("endian") == "big" else "<"
    if kind == "fixed_length_utf32":
        dtype = np.dtype(f"{end}U{about['length_bytes'] // 4}")
    else:
        dtype = np.dtype(object) if text else np.dtype(kind).newbyteorder(end)
    return ChunkedArray(name, tuple(meta["shape"]), chunks, dtype, dims, _fill(meta.get("fill_value"), text), key, codecs[::-1], text, order, attrs)


def _fill(value, text: bool):
    if isinstance(value, str) and not text:
        special = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}
        return special.get(value, value if not value.startswith("0x") else 0)
    return "" if text and value in (None, 0) else value


def arrays(files: Files) -> tuple[dict[str, ChunkedArray], dict]:
    """All arrays of a group, and its attributes."""
    third = files.json("zarr.json")
    if third is None and files.json(".zgroup") is None:
        raise FileNotFoundError(f"no array group at {files.path}")
    known = (files.json(".zmetadata") or {}).get("metadata", {}) if third is None else (third.get("consolidated_metadata") or {}).get("metadata", {})
    names = sorted({k.split("/")[0] for k in known if "/" in k}) if third is None else sorted(known)
    out = {}
    for name in names or files.folders():
        if third is None:
            meta = known.get(f"{name}/.zarray") or files.json(f"{name}/.zarray")
            if meta is not None:
                out[name] = _second(name, meta, known.get(f"{name}/.zattrs") or files.json(f"{name}/.zattrs") or {})
        else:
            meta = known.get(name) or files.json(f"{name}/zarr.json")
            if meta is not None and meta.get("node_type") == "array":
                out[name] = _third(name, meta)
    attrs = (known.get(".zattrs") or files.json(".zattrs") or {}) if third is None else third.get("attributes", {})
    return out, attrs
