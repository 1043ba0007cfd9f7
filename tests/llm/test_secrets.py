import hashlib
import random
import re

import duckdb
import pytest
from corpus import SF, awkward, table

from locuspark.llm import secrets

KEY = "q8Zt1xW0vL5nR3kY7pB2mD9s"


def base(text):
    """The three patterns as the contract words them."""
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SAMPLES = [
    "PassWord = 'abcdef'", "password: short", 'api_key="aaaaaa" APIKEY=bbbbbb', "token=tokenpassword=abcdefg", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "AKIA" + "C" * 15, "0123456789abcdef01234567 0123456789ABCDEF01234567", "ſecret=abcdef1 Key", "secret" + " " * 50 + "= x23456", "é" * 9 + "passwd:" + "0a" * 20, "secret==abcdef", "password=\nabcdefgh",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_patterns(text):
    assert secrets.pattern_spans(text) == base(text)


def test_scan(spark):
    rows = [*enumerate(SAMPLES), *awkward(), *[(100 + i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]]
    got = secrets.scan(table(spark, rows, clashing=True))
    want = sorted(((i, *(sum(s[0] == k for s in base(t)) for k in ("assign", "access", "hex")), hashlib.sha256(line(base(t)).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in got.collect()), key=repr) == want
    for r in got.collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert len(kinds) == r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_novel"]
    assert dict(got.dtypes)["n_assign"] == "bigint" and secrets.scan(table(spark, [])).count() == 0


def test_novelty():
    """Random strings near sensitive words are reported; names, prose, repeats and unrelated strings are not."""
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for k in range(60):
        key = "".join(rng.choice(alphabet if k % 2 else "0123456789ABCDEF") for _ in range(16 + 2 * k)) + "7"
        assert [s[0] for s in secrets.all_spans(f"the private credential for it is {key} and so on")[1]] == ["novel"]
        assert secrets.all_spans(f"the picture of the garden is {key} and so on")[1] == []
    for token in ("get_user_access_token_from_client_2", "application_configuration_settings_1", "xyxyxyxyxyxyxyxyxyxyxyxyxyxy1", "https-www-example-com-path-to-file-2"):
        assert secrets.all_spans(f"the credential {token} here")[1] == [], token
    seen = f"{KEY} is printed here, and the credential is {KEY} again"
    assert secrets.marginal_bytes(KEY, seen) < 0.8 * len(KEY) <= secrets.marginal_bytes(KEY, "nothing of it")


def test_what_counts_as_a_candidate():
    """Letters only, fifteen characters, marks inside, a sensitive word behind: all found; words and addresses never."""
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for alphabet, size in ((letters, 40), (letters + "0123456789", 15), (letters[26:], 30), (letters + "0123456789!#%+/", 12)):
        for text in ("Authorization: Bearer {} is sent", "{} is the credential of it", "the private one, {}."):
            found = 0
            for _ in range(50):
                key = "a" + "".join(rng.choice(alphabet) for _ in range(size - 2)) + "z"
                a = text.index("{}")
                found += ("novel", a, a + size) in secrets.all_spans(text.format(key))[1]
            assert found >= 48, (size, text, found)
    for token in ("yesterday", "Merchantability", "some.one@mail.example.com", "erwords***", "INFRINGEMENT"):
        assert secrets.all_spans(f"the credential {token} here")[1] == [], token
    assert secrets.capacity("abcdefgh") < 40 < secrets.capacity("aB3$efgh")


def test_base_counts_against_sql(spark):
    """The counts of the patterns by another regular expression engine."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.scan(docs).collect()}
    sql = f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)),
        len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)), len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) FROM '{SF}/documents.parquet'"""
    want = {i: tuple(n or 0 for n in c) for i, *c in duckdb.sql(sql).fetchall()}
    assert got == want


def test_redaction(spark):
    assert secrets.redacted("password = abcdef1 and AKIA" + "A" * 16 + ".") == "[ASSIGN] and [ACCESS]."
    assert secrets.redacted("token=" + "0a" * 20 + " x") == "[ASSIGN] x"
    rows = [*enumerate(SAMPLES), *awkward()]
    docs = table(spark, rows, clashing=True)
    got = secrets.without_secrets(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    for r in got.collect():
        assert not base(r["text"]) and (r["text"] is None or r["n_chars"] == len(r["text"]))


def test_secret_that_stands_twice():
    """A key set and then used is reported, and redacted, at both places."""
    text = f"the private credential is {KEY} and later the same credential {KEY} is sent"
    places = [m.span() for m in re.finditer(KEY, text)]
    assert secrets.all_spans(text)[1] == [("novel", a, b) for a, b in places]
    assert KEY not in secrets.redacted(text)
