import random
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from corpus import SF, awkward, table, words

from locuspark.llm import licenses as L
from locuspark.llm.tokens import Runs, raw


def tokens(text):
    return Runs(*raw(pa.array([text]))).words()


def full(template, doc):
    """The most matched tokens of a local alignment, by the whole table."""
    best, above = (0, 0), [(0, 0)] * (len(doc) + 1)
    for want in template:
        row = [(0, 0)]
        for j, token in enumerate(doc):
            cell = (above[j][0] + 1, above[j][1] + 1) if token == want else (above[j][0] - 1, above[j][1])
            row.append(max((0, 0), cell, (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1])))
        best, above = max(best, *row), row
    return best[1]


def test_winnowing_keeps_a_fingerprint_of_every_run():
    rng = random.Random(1)
    for n in (1, 3, 4, 5, 30):
        h = tokens(" ".join(words(rng, n, 8)))
        keys, places = L.winnowed(h)
        covered = [any(a <= p and p + L.GRAM <= a + L.GRAM + L.WINDOW - 1 for p in places) for a in range(n - L.GRAM - L.WINDOW + 2)]
        assert all(covered) and len(keys) == len(places) and (n < L.GRAM) == (not len(keys))


def test_no_permitted_substitution_hides_a_template():
    """However a fifth of the tokens is substituted, enough kept fingerprints are left."""
    rng = random.Random(4)
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 15, 20, 33, 60, 150):
        gram, window, least = L.fingerprint_sizes(n)
        h = np.array(rng.sample(range(10**6), n), np.uint64)
        _, places = L.winnowed(h, gram, window)
        wrong = n - -(-4 * n // 5)
        tries = list(combinations(range(n), wrong)) if n <= 15 else [sorted(rng.sample(range(n), wrong)) for _ in range(200)] + [list(range(4, n, 5))[:wrong]]
        for gone in tries:
            gone = set(gone)
            assert sum(not gone & set(range(p, p + gram)) for p in places) >= least, (n, gone)


def test_alignment():
    at = lambda t, d, low=-99, high=99, share=0.5: L.occurrences(np.array(t), np.array(d), low, high, share)
    assert at([1, 2, 3, 4], [9, 1, 2, 3, 4, 9]) == [(4, 1, 5)] and at([1, 2], [3, 4]) == []
    assert at([1, 2, 3, 4, 5, 6], [1, 2, 3, 9, 4, 5, 6]) == [(6, 0, 7)] and at([1, 2, 3, 4, 5, 6], [1, 2, 3, 5, 6]) == [(5, 0, 5)]
    assert at([1, 2, 3], [1, 2, 3, 1, 2, 3, 7, 1, 2, 3], share=1.0) == [(3, 0, 3), (3, 3, 6), (3, 7, 10)]
    rng = random.Random(3)
    for _ in range(60):
        t, d = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (9, 25))
        assert max([m for m, _, _ in at(t, d, share=0.01)], default=0) >= (full(t, d) > 0)
        most = at(t, d, share=full(t, d) / len(t)) if full(t, d) else [(0, 0, 0)]
        assert max(m for m, _, _ in most) >= full(t, d)


def planted(rng, text):
    """A template with a substituted, a dropped and an added word, somewhere in other text."""
    w = text.split()
    if len(w) > 20:
        w[len(w) // 2] = "changed"
        del w[len(w) // 3]
        w.insert(2 * len(w) // 3, "added")
    before, after = words(rng, rng.randrange(60)), words(rng, rng.randrange(60))
    return " ".join([*before, *w, *after]), len(" ".join(before)), len(" ".join([*before, *w]))


def test_planted_templates(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k, (name, text) in enumerate(L.TEMPLATES.items()):
        body, start, end = planted(rng, text)
        rows.append((k, body))
        want[k] = (name, start, end)
    rows += [(100 + k, " ".join(words(rng, 200))) for k in range(20)]
    got = L.scan(table(spark, rows, clashing=True)).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(want)
    for k, (name, start, end) in want.items():
        (r,) = [r for r in found[k] if r["license"] == name]
        assert r["coverage"] >= 0.8 and abs(r["byte_start"] - start) <= 12 and abs(r["byte_end"] - end) <= 12


def test_against_full_alignment(spark):
    """Of whole texts, each with a license that was changed at random, exactly those are found that the whole table finds."""
    rng = random.Random(12)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 700 ORDER BY doc_id LIMIT 40").fetchall()
    for k in range(160):
        w = rng.choice([t for t in L.TEMPLATES.values() if len(t) < 600]).split()
        for _ in range(rng.randrange(0, 1 + len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], ["changed"], [w[at], "added"]))
        rows.append((5000 + k, " ".join([*words(rng, 9), *w, *words(rng, 9)])))
    library, want = L.Library(), set()
    for i, t in rows:
        h = tokens(t).tolist()
        for name, own in zip(library.names, library.tokens, strict=True):
            if np.isin(own, h).sum() >= 0.8 * len(own) and full(own.tolist(), h) >= 0.8 * len(own) - 1e-9:
                want.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in L.scan(table(spark, rows)).collect()}
    assert got >= want and len(want) > 60 and len(want & got) / len(got) > 0.97, (want - got, got - want)


def test_repeated_and_parted_licenses(spark):
    """A license back to back counts as often as it stands, and one with words in between is one."""
    short, mit = "Released under the MIT License.", L.TEMPLATES["MIT"].split()
    rows = [(1, f"{short} " * 5), (2, f"{short} " * 16_000), (3, "Released under an MIT License."), (4, " ".join([*mit[:40], *("and several words more that were put right there".split()), *mit[40:]])), (5, f"{L.TEMPLATES['MIT']}\n" * 3)]
    got = [(r["doc_id"], r["license"], r["coverage"]) for r in L.scan(table(spark, rows)).collect()]
    count = lambda i, name: sum(g[:2] == (i, name) for g in got)
    assert [count(1, "MIT-short"), count(2, "MIT-short"), count(3, "MIT-short"), count(4, "MIT"), count(5, "MIT")] == [5, 16_000, 1, 1, 3]
    assert {g[2] for g in got if g[0] == 3} == {0.8} and {g[2] for g in got if g[0] in (4, 5)} == {1.0}


def test_awkward_tables(spark):
    rows = [*awkward(), (50, L.TEMPLATES["MIT"] + " " + L.TEMPLATES["MIT"]), (51, "Released under the MIT License.")]
    got = L.scan(table(spark, rows, clashing=True)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(50, "MIT"), (50, "MIT"), (51, "MIT-short")] and L.scan(table(spark, [])).count() == 0
    own = L.scan(table(spark, rows), {"x": "some more words here", "y": "another text with the same id"}, 0.9).collect()
    assert [(r["doc_id"], r["license"]) for r in own] == [(11, "y")]
    library = spark.createDataFrame([("y", "another text with the same id", "z"), ("n", None, "z"), (None, "x", "z"), ("e", " ", "z")], "license string, text string, doc_id string")
    assert [(r["doc_id"], r["license"]) for r in L.scan(table(spark, rows), library, 0.9).collect()] == [(11, "y")]
