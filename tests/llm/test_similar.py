"""Near-duplicates by shingle similarity, and the stage of the pipeline that takes them."""

import random
from itertools import combinations

import corpus_pipeline as C
from corpus import awkward, groups, table, words

from locuspark.llm import similar


def shingle_set(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    alike = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0]
    root = groups(alike, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted(((i, least.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)


def edited_rows():
    """Groups of a text and copies with one to eight words replaced: similarities on both sides of 0.8."""
    rng, rows = random.Random(8), []
    for _ in range(40):
        base = words(rng, rng.randrange(60, 200))
        for edits in range(8):
            own = list(base)
            for at in rng.sample(range(len(own)), edits):
                own[at] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


def test_against_all_pairs(spark):
    for rows in (edited_rows(), awkward(), []):
        got = similar.near_duplicates(table(spark, rows, clashing=True)).select("doc_id", "component_id")
        assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def majority(text):
    import xxhash

    hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42) for w in shingle_set(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def within_radius(rows):
    """The smallest row that each one reaches by fingerprints of at most six differing bits; without words: itself."""
    bits = [majority(t) for _, t in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(bits[i] ^ bits[j]).count("1") <= 6 and shingle_set(rows[i][1]) and shingle_set(rows[j][1])]
    return groups(near, range(len(rows)))


def test_fingerprints_propose(spark):
    """Without minimum hashes, exactly the similar texts that covering hashing of SimHashes connects are linked."""
    rows = edited_rows()
    sets, reach = [shingle_set(t) for _, t in rows], within_radius(rows)
    alike = [(i, j) for i, j in combinations(range(len(rows)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    seen = [(i, j) for i, j in alike if reach[i] == reach[j]]
    root, least = groups(seen, range(len(rows))), {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    got = similar.near_duplicates(table(spark, rows), bands=False).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted((i, least[root[k]]) for k, (i, _) in enumerate(rows))
    assert 0 < len(seen) < len(alike)


def test_fingerprint_buckets(spark):
    """A bucket for each group of fingerprints within the radius, equal ones of different sets included."""
    rows = [*edited_rows(), (5000, "one two three"), (5001, "ONE  two three"), (5002, ""), (5003, None)]
    fps = {k: similar.identity(similar.shingles((t or "").encode())) for k, (_, t) in enumerate(rows)}
    sims = {k: similar.fingerprint(similar.shingles((t or "").encode())) for k, (_, t) in enumerate(rows)}
    assert all(s & (1 << 64) - 1 == majority(rows[k][1]) for k, s in sims.items())
    distinct = {fps[k]: (fps[k], sims[k], len(shingle_set(t))) for k, (_, t) in enumerate(rows)}
    distinct[77] = (77, sims[0], 3)
    got = {}
    for r in similar.fingerprint_buckets(spark.createDataFrame(list(distinct.values()), "fp long, sim long, n long")).collect():
        got.setdefault(r["bucket"], set()).add(r["fp"])
    want = {}
    for k, r in within_radius(rows).items():
        want.setdefault(r, set()).add(fps[k])
    next(w for w in want.values() if fps[0] in w).add(77)
    assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)


def test_masks_cover():
    """Every set of up to six differing bits misses some table's mask, and a mask keeps 32 bits."""
    keep, rng = similar.masks(), random.Random(2)
    assert len(keep) == 126 and {m.bit_count() for m in keep} == {32}
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 6))
        assert any(diff & m == 0 for m in keep)


def test_large_tables(spark):
    """Keys of many fingerprints connect at least what all pairs connect, in parts and as a whole."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    sims = sorted({c ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 5))) for c in [rng.randrange(1 << 62) for _ in range(4)] for _ in range(30)})
    df = spark.createDataFrame([(s,) for s in sims], "sim long")
    near = groups([(a, b) for a, b in combinations(sims, 2) if (a ^ b).bit_count() <= 6], sims)
    assert groups([tuple(r) for r in similar.within_radius(df).collect()], sims) == near
    loose = groups([tuple(r) for r in similar.within_radius(df, most=2).collect()], sims)
    assert all(loose[a] == loose[b] for a, b in near.items())
    keys, vals = [1] * 3 + [2] * 9 + [3], list(range(13))
    for size in (2, 13):
        parts = [similar._links(np.array(keys[i : i + size]), np.array(vals[i : i + size])) for i in range(0, 13, size)]
        got = pa.Table.from_batches(similar._connect(3)(iter(parts))).to_pylist()
        assert groups([(r["a"], r["b"]) for r in got], vals) == {0: 0, 1: 0, 2: 0} | {k: 3 for k in range(3, 12)} | {12: 12}


def test_buckets_in_pieces(spark):
    """Buckets that do not fit into a task give the same components, whatever the size of a piece."""
    rng = random.Random(2)
    base, rows = words(rng, 120), edited_rows()
    for k in range(60):  # a chain: each text links to the next, far ones do not
        base[2 * k % 120] = f"next{k}"
        rows.append((2000 + k, " ".join(base)))
    want = expected(rows)
    for most in (100, 700):
        got = similar.near_duplicates(table(spark, rows), most=most).select("doc_id", "component_id")
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_crossing():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40))).astype(np.uint64) for _ in range(60)]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    a, b = similar.crossing(sets[:35], sets[35:], 0.5)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(35) for j in range(25) if jaccard(sets[i], sets[35 + j]) >= 0.5}


def test_stage_removes_edited_copies(spark):
    """The stage keeps one text of each group of similarity 0.8, whatever the bits of a fingerprint say."""
    rows = edited_rows()
    kept = sorted(r["doc_id"] for r in C.near_duplicates(spark, table(spark, rows), "").collect())
    assert kept == sorted({c for _, c in expected(rows)})
