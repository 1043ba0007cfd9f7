"""Secret scan: three patterns, and dictionary-primed zstandard novelty.

Beside the pattern spans, every string near a sensitive word (on either side)
that could carry enough information is a candidate: its length times the bits
of the character classes in it reaches ``BITS``, or ``WORD_BITS`` if it is
shaped like a word, as shorter ones cannot be told from words. Its novelty is
the number of bytes by which a zstandard frame grows when the candidate follows
its surroundings, with a compressor primed by an identifier dictionary and by
those surroundings: names, prose and repeated material cost little, random
strings cost all that their characters can cost. Candidates whose marginal
bytes reach ``NOVELTY`` of that are reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from locuspark.llm.frames import columns, map_text, schema_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9+/_~!@#$%^&*.-]*[A-Za-z0-9+/_~@#$%^&*])?={0,2}")
#: Character classes and how many characters each has.
CLASSES = tuple((re.compile(p), n) for p, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 32)))
#: Repeated marks around a string belong to the text, and mail addresses are no secrets.
DECORATION, ADDRESS = re.compile(r"([^A-Za-z0-9=])\1+\Z"), re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.ASCII)
WORDLIKE = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
SENSITIVE = re.compile(r"passw|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|signature|AKIA", re.IGNORECASE | re.ASCII)
#: Characters before or after a candidate that must hold a sensitive word, and of its surroundings.
NEAR, AROUND = 80, 1024
#: Bits that a candidate, and one shaped like a word, can carry at least.
BITS, WORD_BITS = 50.0, 75.0
#: Share of a candidate's full cost from which it is reported.
NOVELTY = 0.8
#: From this length on the compressor codes characters by their frequency; shorter strings cost a byte each.
CODED = 56

_NAMES = """password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential
username user_id session_id request_id response content_type application json config settings environment variable default
function return import public static final string integer boolean value result error message length number object array list
index create update delete select insert table column database connection server client host port path file directory name
type class method parameter argument description version license copyright https http www com org net example localhost
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 ffffffffffffffff xxxxxxxxxxxxxxxx
aaaaaaaaaaaaaaaa changeme placeholder your_token_here your_api_key_here EXAMPLEKEY TODO FIXME deadbeef 1234567890"""


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, leftmost and non-overlapping in each kind; code points, end exclusive."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def marginal_bytes(candidate: str, around: str, names: str = _NAMES) -> int:
    """Compressed size of surroundings and candidate, less that of the surroundings alone."""
    import zstandard

    prime = zstandard.ZstdCompressionDict((names + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    small = zstandard.ZstdCompressor(level=9, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    tail = around[-32:].encode()
    return len(small.compress(tail + candidate.encode())) - len(small.compress(tail))


def full_cost(candidate: str) -> float:
    """Bytes that ``candidate`` costs if nothing of it is known."""
    n = len(candidate)
    if n < CODED:
        return n
    return sum(-k * math.log2(k / n) for k in Counter(candidate).values()) / 8


def capacity(candidate: str) -> float:
    """Bits that a random string of this length and these character classes carries."""
    return len(candidate) * math.log2(sum(n for found, n in CLASSES if found.search(candidate)))


def novel_spans(text: str, known: list[tuple[str, int, int]], novelty: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Candidates of high novelty that no pattern covers wholly."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = DECORATION.sub("", m.group())
        a, b = m.start(), m.start() + len(token)
        if len(token) < 8 or ADDRESS.fullmatch(token) or (capacity(token.lower()) < WORD_BITS if WORDLIKE.fullmatch(token) else capacity(token) < BITS):
            continue
        if not (SENSITIVE.search(text, max(0, a - NEAR), a) or SENSITIVE.search(text, b, b + NEAR)):
            continue
        if any(s <= a and b <= e for _, s, e in known):
            continue
        # A secret that stands twice must not vouch for itself.
        around = (text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]).replace(token, " ")
        if marginal_bytes(token, around) >= novelty * full_cost(token):
            out.append(("novel", a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Pattern spans, and those with the novel ones; a null text is empty."""
    if not text:
        return [], []
    base = pattern_spans(text)
    more = novel_spans(text, base) if SENSITIVE.search(text) else []
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None, mark: str = "[{}]") -> str | None:
    """``text`` with each maximal run of overlapping spans replaced by a mark that names the first kind."""
    if not text:
        return text
    out, at = [], 0
    runs: list[list] = []
    for kind, a, b in all_spans(text)[1]:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([kind, a, b])
    for kind, a, b in runs:
        out += [text[at:a], mark.format(kind.upper())]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """Digest of the secrets of each row: counts, hash of the pattern spans, all spans.

    Null and empty texts have no span; repeated rows come back repeated; a null
    doc_id stays null.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        found = [all_spans(t) for t in batch.column("text").to_pylist()]
        count = {k: [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS[:3]}
        return {
            "doc_id": batch.column("doc_id"), **{f"n_{k}": v for k, v in count.items()},
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
            "spans": [joined(both) for _, both in found], "n_novel": [len(both) - len(base) for base, both in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(columns(docs, "doc_id", "text"), fn, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets redacted and ``n_chars``, if there, counted anew; null texts stay null, every row stays."""
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> dict:
        texts = [redacted(t) for t in batch.column("text").to_pylist()]
        out = {c: batch.column(c) for c in names} | {"text": texts}
        if "n_chars" in out:
            out["n_chars"] = [None if t is None else len(t) for t in texts]
        return out

    return map_text(docs, fn, schema_of(docs))
