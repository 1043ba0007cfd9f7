import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpus import awkward, groups, table, words

from locuspark.llm import simhash
from locuspark.llm.components import components


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(parts[i : i + 4]) for i in range(len(parts) - 3)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = groups([(i, j) for i, j in combinations(range(len(rows)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 4], range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted(((i, f"{fps[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)


def corpus_rows():
    rng = random.Random(4)
    rows = []
    for k in range(60):
        base = words(rng, rng.randrange(1, 120))
        rows.append((len(rows) * 3 % 1000, " ".join(base)))
        for _ in range(k % 4):
            edited = list(base)
            edited[rng.randrange(len(base))] = "Edit"
            rows.append((len(rows) * 3 % 1000, " ".join(edited).upper() if k % 2 else "  ".join(edited)))
    return rows


@pytest.mark.parametrize("rows", [corpus_rows(), awkward(), []])
def test_against_all_pairs(spark, rows):
    got = simhash.near_duplicates(table(spark, rows, clashing=True))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_masks_cover():
    """Every set of up to four differing bits misses some table's mask."""
    rng = random.Random(2)
    keep = simhash.masks()
    assert len(keep) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in keep)
    small = simhash.masks(1)
    assert all(any((1 << b) & m == 0 for m in small) for b in range(64))


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_large_buckets(spark, most):
    """Whatever way a bucket goes, the links connect what all pairs connect."""
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                c ^= 1 << int(bit)
            fps.add(c)
    fps = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), most=most).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 or most < 4096 for a, b in links)
    brute = [(a, b) for a, b in combinations(fps, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    assert groups([tuple(r) for r in links], fps) == groups(brute, fps)


def test_runs_across_batches():
    keys = [1, 1, 2, 2, 2, 2, 2, 2, 3]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array(range(i, i + len(keys[i : i + 2])))], names=["k", "v"]) for i in range(0, 9, 2)]
    got = [(k.tolist(), v.tolist(), long) for k, v, long in simhash._runs(iter(batches), 3)]
    assert [v for _, vs, _ in got for v in vs] == list(range(9)) and [long for ks, _, long in got if 2 in ks] == [True] * len([1 for ks, _, _ in got if 2 in ks])


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    want = groups(edges, {x for e in edges for x in e})
    got = components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_deduplicated(spark):
    rows = [*corpus_rows(), (None, "left alone"), (None, "left alone"), (5000, "same id"), (5000, "same id"), (5001, "same id")]
    docs = table(spark, rows, clashing=True)
    got = simhash.deduplicated(docs)
    want = sorted({i for i, _, c in expected(rows) if i is not None and i == c})
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want and got.where("doc_id is null").count() == 2
    assert simhash.deduplicated(table(spark, [])).count() == 0


def test_hot_fingerprints(spark, monkeypatch):
    """Fingerprints of very many rows get their names by another way, and the same ones."""
    rows = [(k, "") for k in range(40)] + [(100 + k, "the very same words here") for k in range(30)] + [(200 + k, f"other text number {k} " * 3) for k in range(20)]
    want = sorted(map(tuple, simhash.near_duplicates(table(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "HOT", 25)
    assert sorted(map(tuple, simhash.near_duplicates(table(spark, rows)).collect())) == want and len(want) == 90
