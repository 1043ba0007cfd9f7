"""WARC derivatives: metadata and plain-text conversion records of responses.

``responses`` are rows ``record_id, target_uri, date, http_headers, payload``
and, if known, ``payload_digest, warc_headers`` (from WARC files by
:func:`read_responses`, or from a page table by :func:`page_responses`). Each
gives a ``metadata`` record (source headers, title, character set, outlinks)
and a ``conversion`` record (plain text). Both keep the response's identifier
in WARC-Refers-To, its payload digest and its target, and name each other in
WARC-Concurrent-To and a field. A payload of bytes is taken as it was sent: its
digest is the source's or that of those bytes, and transfer and content
encodings are undone before it is decoded by the declared character set.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm.frames import map_text

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
#: A tag from its ``<``; the possessive repeat never goes back, so that it is read once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_HREF = re.compile(r"""(?:^|[\s/"'])href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']++))""", re.IGNORECASE)
_CHARSET = re.compile(r"""charset\s*+=\s*+["']?([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
#: Elements whose content is not shown; the first two take all up to their end tag or the end of the page.
_RAW = ("script", "style")
_HIDDEN = frozenset((*_RAW, "noscript", "template", "title"))
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.IGNORECASE) for name in _HIDDEN}
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
RECORD = "source_id string, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, block string"


def digest(block: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class Page:
    """Visible text, title and link targets of a page, in one pass over it."""

    def __init__(self, page: str):
        self.title: str | None = None
        self.links: list[str] = []
        parts: list[str] = []
        unclosed: set[str] = set()
        at, n = 0, len(page)
        while at < n:
            mark = page.find("<", at)
            if mark < 0:
                mark = n
            parts.append(page[at:mark])
            if mark + 1 >= n:
                break
            follows = page[mark + 1]
            if follows in "!?":
                comment = page.startswith("<!--", mark)
                end = page.find("-->" if comment else ">", mark + 2)
                at = n if end < 0 else end + (3 if comment else 1)
                parts.append(" " if comment else "")
            elif not (follows.isascii() and follows.isalpha() or follows == "/" and page[mark + 2 : mark + 3].isalpha()):
                parts.append("<")
                at = mark + 1
            elif not (tag := _TAG.match(page, mark)):
                break  # a tag that never ends takes the rest of the page, as in browsers
            else:
                at = self._tag(page, tag, parts, unclosed)
        lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).replace("\xa0", " ").split("\n"))
        self.text = "\n".join(line for line in lines if line)

    def _tag(self, page: str, tag: re.Match, parts: list[str], unclosed: set[str]) -> int:
        """Takes a tag in; where the text goes on."""
        name = tag[2].lower()
        if name in _BLOCK:
            parts.append("\n")
        if tag[1] or name not in _HIDDEN:
            if name == "a" and not tag[1] and (m := _HREF.search(tag[3])):
                self.links.append(html.unescape(next(x for x in m.groups() if x is not None)).strip())
            return tag.end()
        close = None if name in unclosed else _CLOSE[name].search(page, tag.end())
        if close is None:
            unclosed.add(name)
            return len(page) if name in _RAW else tag.end()
        if name == "title" and self.title is None:
            self.title = " ".join(html.unescape(page[tag.end() : close.start()]).split())
        parts.append(" ")
        return close.end()


def plain_text(page: str) -> str:
    """Visible text: block elements part lines, other tags vanish, white space collapses."""
    return Page(page).text


def _headers(head: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.replace("\r\n", "\n").split("\n")[1:])}


def unchunked(body: bytes) -> bytes:
    """A body without its chunk sizes; one that is not in chunks stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join([*out, body[at:]])
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out) if out else b"" if body.startswith(b"0") else body


def decoded(headers: str, payload: bytes) -> str:
    """The text of a payload: encodings undone, then the character set of the headers, a byte-order mark, the page, or UTF-8.

    What cannot be undone stays as it is, and what cannot be decoded is replaced.
    """
    head = _headers(headers)
    if "chunked" in head.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed([c.strip().lower() for c in head.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):  # with either header, or bare
                try:
                    payload = zlib.decompressobj(bits).decompress(payload)
                    break
                except zlib.error:
                    continue
    names = [m[1] for m in (_CHARSET.search(head.get("content-type", "")),) if m]
    names += [name for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")) if payload.startswith(mark)]
    names += [m[1] for m in (_CHARSET.search(payload.decode("latin-1")),) if m]
    for name in names:
        try:
            return payload.decode(name, "replace")
        except LookupError:
            continue
    return payload.decode("utf-8", "replace")


def fields(headers: str, page: str, parsed: Page, text_id: str, warc_headers: str = "") -> str:
    """The block of a metadata record: one field a line."""
    out = [("derived-conversion", f"<{text_id}>")]
    status, *lines = headers.replace("\r\n", "\n").strip().split("\n") if headers.strip() else [""]
    out += [("source-header", line) for line in warc_headers.replace("\r\n", "\n").split("\n") if line.strip()]
    out += [("http-status", status)] if status else []
    out += [("http-header", line.strip()) for line in lines if line.strip()]
    if m := _CHARSET.search(headers) or _CHARSET.search(page):
        out.append(("charset", m[1].lower()))
    if parsed.title is not None:
        out.append(("title", parsed.title))
    out += [("outlink", link) for link in parsed.links]
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in out)


def derived(source: str | None, uri: str | None, date: str | None, headers: str | None, page: str | bytes | None, payload_digest: str | None = None, warc_headers: str | None = None) -> list[dict]:
    """The two records of one response. A null payload, header or target counts as empty."""
    page, headers, uri = page or "", headers or "", uri or ""
    sent = page if isinstance(page, bytes) else page.encode()
    payload = payload_digest or digest(sent)
    source = source or f"urn:uuid:{uuid.uuid5(SPACE, uri + ' ' + payload)}"
    meta_id, text_id = (f"urn:uuid:{uuid.uuid5(SPACE, f'{source} {kind}')}" for kind in ("metadata", "conversion"))
    text = decoded(headers, page) if isinstance(page, bytes) else page
    parsed = Page(text)
    out = []
    for kind, own, other, block, content in (("metadata", meta_id, text_id, fields(headers, text, parsed, text_id, warc_headers or ""), "application/warc-fields"), ("conversion", text_id, meta_id, parsed.text, "text/plain; charset=utf-8")):
        raw = block.encode("utf-8", "replace")
        out.append({"source_id": f"<{source}>", "record_type": kind, "record_id": f"<{own}>", "refers_to": f"<{source}>", "concurrent_to": f"<{other}>", "target_uri": uri, "warc_date": date, "content_type": content, "content_length": len(raw), "block_digest": digest(raw), "payload_digest": payload, "block": raw.decode()})
    return out


_RESPONSE = ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "warc_headers")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each row of ``responses``; repeated rows give repeated records.

    A payload of text is taken as decoded already; without a column for them
    source digests and WARC headers count as unknown.
    """
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def fn(batch: pa.RecordBatch) -> dict:
        rows = [r for row in zip(*(batch.column(c).to_pylist() for c in _RESPONSE), strict=True) for r in derived(*row)]
        return {n: [r[n] for r in rows] for n in names}

    known = set(responses.columns)
    binary = responses.schema["payload"].dataType.typeName() == "binary"
    own = [(responses[c].cast("binary" if c == "payload" and binary else "string") if c in known else F.lit(None).cast("string")).alias(c) for c in _RESPONSE]
    return map_text(responses.select(*own), fn, RECORD, "payload")


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A page table (``page_id, url, html``) as responses; identifiers derive from page_id and url."""
    page = F.coalesce(pages["html"], F.lit(""))
    key = F.sha2(F.concat_ws(" ", F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.coalesce(pages["url"], F.lit(""))), 256)
    ident = F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.substring(key, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n"))
    return pages.select(ident.alias("record_id"), pages["url"].alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), pages["html"].alias("payload"))


def record_bytes(row: dict) -> bytes:
    """A derived record as WARC/1.1 bytes."""
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"] or ""), ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Concurrent-To", row["concurrent_to"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Payload-Digest", row["payload_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + row["block"].encode() + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """(headers by lower-case name, headers as they stand, block) of each record of an open WARC file, one at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        lines = []
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            name, _, value = text.partition(":")
            head[name.strip().lower()] = value.strip()
            lines.append(text)
        yield head, "\n".join(lines), stream.read(int(head.get("content-length") or 0))


def opened(uri: str):
    """A WARC file as a stream, plain or gzip (a member a record or one for all)."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        packed = f.read(2) == b"\x1f\x8b"
    stream = io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=stream) if packed else stream


#: Bytes of responses that are handed on at once.
HELD = 8 << 20


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses of WARC files, payloads as they were sent; files are streamed, one by one in each task.

    A compressed file cannot be split, so a file is the unit of work; of it one
    record and ``HELD`` bytes are in memory.
    """
    schema = "record_id string, target_uri string, date string, http_headers string, payload binary, payload_digest string, warc_headers string"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary() if n == "payload" else pa.string() for n in _RESPONSE]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(_RESPONSE))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in it:
            for uri in paths.column(0).to_pylist():
                rows, held = [], 0
                with opened(uri) as stream:
                    for head, lines, block in records(stream):
                        if head.get("warc-type") != "response":
                            continue
                        top, _, body = block.partition(b"\r\n\r\n")
                        rows.append((head.get("warc-record-id", "").strip("<>"), head.get("warc-target-uri"), head.get("warc-date"), top.decode("latin-1"), body, head.get("warc-payload-digest"), lines))
                        held += len(block)
                        if held > HELD:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, schema)


def write_records(derived_records: DataFrame, path: str) -> None:
    """One gzip member a record, as rows of one binary column in Parquet files under ``path``; concatenated they are a WARC file."""
    names = derived_records.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [gzip.compress(record_bytes(dict(zip(names, r, strict=True))), mtime=0) for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(rows, pa.binary())], names=["record_id", "member"])

    derived_records.mapInArrow(run, "record_id string, member binary").write.parquet(path)
