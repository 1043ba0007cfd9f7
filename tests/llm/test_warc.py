import base64
import gzip
import hashlib
import io
import re
import time

import duckdb
from corpus import SF

from locuspark.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p {x}</style></head><body><!-- no --><h1>Head</h1><p>One <b>two</b>&nbsp;three<br>four</p>
<script>var x = "<p>";</script><a href="/a?x=1&amp;y=2">link</a><a href='b.html'>c</a> 1 &lt; 2</body></html>"""


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_one_page(spark):
    rows = [("urn:uuid:1", "http://x/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Odd:  a  b \r\n", PAGE)]
    got = {r["record_type"]: r.asDict() for r in warc.derivatives(spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string")).collect()}
    meta, text = got["metadata"], got["conversion"]
    assert text["block"] == "Head\nOne two three\nfour\nlinkc 1 < 2"
    lines = meta["block"].split("\r\n")
    assert lines[:4] == [f"derived-conversion: {text['record_id']}", "http-status: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=UTF-8", "http-header: X-Odd: a b"]
    assert lines[4:] == ["charset: utf-8", "title: A & B", "outlink: /a?x=1&y=2", "outlink: b.html", ""]
    for r in (meta, text):
        assert r["refers_to"] == r["source_id"] == "<urn:uuid:1>" and r["target_uri"] == "http://x/" and r["payload_digest"] == sha(PAGE.encode()) and r["block_digest"] == sha(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"] and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", meta["record_id"])


def test_whole_table_and_files(spark, tmp_path):
    """Every page gives two records; written as WARC members they read back as they were."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    derived = warc.derivatives(warc.page_responses(pages))
    rows = derived.collect()
    n = pages.count()
    assert len(rows) == 2 * n and len({r["record_id"] for r in rows}) == 2 * n and len({r["source_id"] for r in rows}) == n
    digests = {}
    for page_id, url, page in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall():
        key = hashlib.sha256(f"{page_id} {url}".encode()).hexdigest()
        digests[f"<urn:uuid:{key[:8]}-{key[8:12]}-5{key[13:16]}-8{key[17:20]}-{key[20:32]}>"] = sha((page or "").encode())
    assert len(digests) == n
    for r in rows:
        assert r["payload_digest"] == digests[r["source_id"]]
        assert "<p>" not in r["block"] or r["record_type"] == "metadata"
    warc.write_records(derived, str(tmp_path / "out"))
    members = spark.read.parquet(str(tmp_path / "out")).collect()
    by_id = {r["record_id"]: r for r in rows}
    stream = lambda data: gzip.GzipFile(fileobj=io.BytesIO(data))
    (head, _, block), = warc.records(stream(bytes(members[0]["member"])))
    own = by_id[members[0]["record_id"]]
    assert head["warc-refers-to"] == own["refers_to"] and head["warc-block-digest"] == sha(block) and block.decode() == own["block"]
    both = list(warc.records(stream(b"".join(bytes(m["member"]) for m in members[:5]))))
    assert [b.decode() for _, _, b in both] == [by_id[m["record_id"]]["block"] for m in members[:5]]


def test_read_responses(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    record = lambda kind, name, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: http://{name}/\r\nWARC-Date: 2024-02-03T04:05:06Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    parts = [record("warcinfo", "w", b"x: y\r\n"), record("response", "a", http), record("request", "q", b"GET /"), record("response", "b", http)]
    (tmp_path / "one.warc").write_bytes(b"".join(parts))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], r["target_uri"], bytes(r["payload"])) for r in got) == [("urn:uuid:a", "http://a/", b"<p>hello</p>")] * 2 + [("urn:uuid:b", "http://b/", b"<p>hello</p>")] * 2
    assert warc.derivatives(warc.read_responses(spark, str(tmp_path / "one.warc"))).where("record_type = 'conversion'").first()["block"] == "hello"


def test_awkward_pages(spark):
    long = "<p>" + "x " * 200_000
    rows = [(None, None, None), (1, "http://a/", None), (1, "http://a/", ""), (2, "http://b/", "<title"), (2, "http://b/", "<title"), (3, None, "<script>never closed"), (4, "u", long), (5, "u", "&#0; &bogus; <a href=>"), (6, "u", "<" * 5000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, record_id string")
    got = warc.derivatives(warc.page_responses(pages)).collect()
    assert len(got) == 2 * len(rows) and all(r["record_id"] and r["block_digest"] for r in got)
    assert {r["block"] for r in got if r["target_uri"] == "http://a/" and r["record_type"] == "conversion"} == {""}
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0


def test_payloads_as_sent(spark, tmp_path):
    """Encoded payloads: the source's digest and headers stay, and the text is that of the page."""
    page = "<html><head><title>Grüße</title><body>süß</body>"
    chunk = lambda b: b"".join(f"{len(b[k:k+7]):x}\r\n".encode() + b[k : k + 7] + b"\r\n" for k in range(0, len(b), 7)) + b"0\r\n\r\n"
    cases = [
        ("Content-Type: text/html; charset=iso-8859-1", page.encode("latin-1")), ("Content-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip", gzip.compress(page.encode())),
        ("Content-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked", chunk(page.encode())), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunk(gzip.compress(page.encode()))),
        ("Content-Type: text/html", (" " * 5000 + page.replace("<body>", "<meta charset=windows-1252><body>")).encode("cp1252")), ("Content-Type: text/html", page.encode("utf-16")), ("Content-Type: text/html; charset=nonsense", page.encode()), ("Content-Encoding: gzip", page.encode()),
    ]
    parts = []
    for k, (head, body) in enumerate(cases):
        block = b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n\r\n" + body
        own = f"WARC-Payload-Digest: sha1:SOURCE{k}\r\nWARC-Block-Digest: {sha(block)}\r\n" if k % 2 else ""
        parts.append(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Target-URI: http://{k}/\r\n{own}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    rows = warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        k = int(r["source_id"].removeprefix("<urn:uuid:")[:-1])
        assert r["payload_digest"] == (f"sha1:SOURCE{k}" if k % 2 else sha(cases[k][1]))
        if r["record_type"] == "conversion":
            assert r["block"] == "süß", k
        else:
            assert "title: Grüße\r\n" in r["block"] and f"source-header: WARC-Target-URI: http://{k}/\r\n" in r["block"] and ("source-header: WARC-Block-Digest" in r["block"]) == bool(k % 2)


def test_odd_pages():
    """Open elements lose nothing but raw text, and the time is in proportion to the page."""
    assert warc.plain_text("<html><head><title>T</title><body><p>all of it") == "all of it" and warc.Page("<title>a <b> b</title>x").title == "a <b> b"
    assert warc.plain_text("<noscript>on <template>and on") == "on and on" and warc.plain_text("<title>on and on") == "on and on"
    assert warc.plain_text("a<script>b</script>c<style>d") == "a c" and warc.plain_text("1 < 2 <3 </ > <p>x</p><!-- y") == "1 < 2 <3 </ >\nx"
    assert warc.Page("<a title=\"x>y\" href='u?a=1&amp;b'>k</a><a data-href=no>l</a><a\nHREF = v>").links == ["u?a=1&b", "v"]
    for hostile in ("<a ", "<a href=", "<a href='", "<template>", "<noscript><p>", "<!-", "<title>", "</", "<a =\"", "charset =  ", "<!--", "<x y='"):
        began = time.time()
        warc.derived("s", "u", None, "", hostile * 100_000)
        assert time.time() - began < 3, hostile
