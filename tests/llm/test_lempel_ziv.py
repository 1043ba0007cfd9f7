import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpus import SF, awkward, table, words

from locuspark.llm import lempel_ziv as L


def parsed(text):
    """Greedy dictionary parsing, phrase by phrase."""
    known, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        if end > len(text):
            break
        known.add(text[at:end])
        at = end
    return known


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) - len(t) // 3
        edited = t[:cut] + nxt[: len(t) // 3]
        own, new, other = L.signatures([parsed(t), parsed(edited), parsed(nxt)])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), new.tobytes().hex(), float(L.likeness(own, new)), float(L.likeness(own, other))))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("rows", [awkward(), [], [(4, "just one document of its own")], [(3, ""), (2, None)]])
def test_awkward_tables(spark, rows):
    got = L.compared_with_next(table(spark, rows, clashing=True))
    assert got.columns == NAMES and sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    got = sorted(map(tuple, L.compared_with_next(spark.read.parquet(f"{SF}/documents.parquet")).collect()), key=repr)
    assert got == expected(rows)
    near = np.array([r[5] for r in got])
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got) and np.median(near) > 0.4


def test_likeness_estimates_jaccard():
    rng = random.Random(9)
    for share in (0.2, 0.5, 0.9):
        common, errors = [f"c{k}" for k in range(int(2000 * share))], []
        for t in range(8):
            a, b = ({*common, *(f"{x}{t}{k}" for k in range(1000 - len(common) // 2))} for x in "ab")
            sig = L.signatures([a, b])
            errors.append(float(L.likeness(sig[0], sig[1])) - len(a & b) / len(a | b))
        assert abs(np.mean(errors)) < 0.05
    empty = L.signatures([set(), {"x"}])
    assert L.likeness(empty[0], empty[0]) == 1 and L.likeness(empty[0], empty[1]) == 0 and rng


def test_copies_and_compression(spark):
    rng = random.Random(2)
    base = " ".join(words(rng, 400))
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "w2 ")), (4, " ".join(words(rng, 400, 10**6)))]
    got = {r["doc_id"]: r["fingerprint"] for r in L.fingerprints(table(spark, rows)).collect()}
    assert got[1] == got[2] and Counter(got)[4]
    sig = {k: np.frombuffer(bytes.fromhex(v), np.uint8) for k, v in got.items()}
    assert L.likeness(sig[1], sig[3]) > L.likeness(sig[1], sig[4])


def test_ids_that_are_no_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        L.compared_with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
