import hashlib
import random

import duckdb
import numpy as np
import pytest
from corpus import SF, awkward, table

from locuspark.llm import frames, suffix_dedup
from locuspark.llm.difference_cover import ranks, same_prefixes


def expected(rows, length):
    """Windows of smaller documents by brute force."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, d in data:
        if i is not None:
            for k in range(len(d) - length + 1):
                w = d[k : k + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        if i is not None:
            for k in range(len(d) - length + 1):
                if first[d[k : k + length]] < i:
                    gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        rows.append((k * 7 % 101, "".join(parts)))
    return [*rows, (200, "a" * 90), (201, "a" * 30), (199, "a" * 11), (202, "ab" * 40), (203, "ab" * 40)]


@pytest.mark.parametrize(("seed", "length", "gram", "crowd", "chunk", "least"), [(1, 8, 4, 4096, 10_000, 99), (2, 11, 3, 2, 50, 2), (3, 6, 6, 0, 1, 3), (4, 20, 9, 3, 500, 1), (5, 9, 4, 4096, 300, 4)])
def test_against_brute_force(spark, seed, length, gram, crowd, chunk, least):
    """Whatever counts as crowded or hot, the result is the same."""
    rows = random_rows(seed)
    got = suffix_dedup.deduplicated(table(spark, rows), length, gram, crowd, chunk, 40, least)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and sorted(map(tuple, got.collect()), key=repr) == expected(rows, length)


def test_production_parameters(spark):
    """The smallest corpus with its copies, and passages repeated across documents."""
    rows = [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY length(text) LIMIT 150").fetchall()]
    rows += [(9001, "pre " + rows[140][1][10:200] + " post"), (9002, rows[120][1]), (9003, None)]
    assert sorted(map(tuple, suffix_dedup.deduplicated(table(spark, rows)).collect()), key=repr) == expected(rows, 50)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts longer than a piece give what whole texts give."""
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(1, part), (2, "x" * 333 + part[100:650] + "y" * 90), (3, part * 3), (4, part[:49]), (5, "".join(rng.choice("ab") for _ in range(900)))]
    data = np.frombuffer((part * 3).encode(), np.uint8)
    off = np.array([0, len(data)])
    one, many = suffix_dedup.Contexts(data, off, 50, 20), suffix_dedup.Contexts(data, off, 50, 20, piece=64)
    spread = lambda c: [(w, g) for a, b, g in zip(c.lo.tolist(), c.hi.tolist(), c.gram.tolist(), strict=True) for w in range(a, b + 1)]
    assert spread(one) == spread(many) and len(many.lo) > len(one.lo)
    starts = np.array([0, 10, 63, 64, 65, 700, 2000])
    assert one.windows(starts).tolist() == many.windows(starts).tolist()
    monkeypatch.setattr(suffix_dedup.Contexts.__init__, "__defaults__", (None, 64, suffix_dedup.ROOT))
    monkeypatch.setattr(suffix_dedup, "slices", lambda it, most: frames.slices(it, most=1))  # texts longer than a slice come alone
    got = suffix_dedup.deduplicated(table(spark, rows).coalesce(1))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, 50)


def test_hot_grams(spark):
    """A line between other lines in every document is found to be hot."""
    rng = random.Random(3)
    line = "this very line stands in each and every document of them"
    rows = [(k, "".join(rng.choice("abcdefghijkl ") for _ in range(80)) + line + "".join(rng.choice("abcdefghijkl ") for _ in range(80))) for k in range(100)]
    hot = suffix_dedup.hot_grams(table(spark, rows), 50, 20, 1.0, 50)
    assert 0 < len(hot) < 10 and (hot[:-1] < hot[1:]).all()
    got = suffix_dedup.deduplicated(table(spark, rows), least=50)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, 50)


@pytest.mark.parametrize("rows", [awkward(), [], [(1, None)]])
def test_awkward_tables(spark, rows):
    got = sorted(map(tuple, suffix_dedup.deduplicated(table(spark, rows, clashing=True)).collect()), key=repr)
    assert got == expected(rows, 50)


@pytest.mark.parametrize("kind", ["random", "ones", "period", "few"])
def test_suffix_ranks(kind):
    rng = np.random.default_rng(3)
    for n in [*range(12), 50, 101, 300]:
        s = {"random": rng.integers(1, 4, n), "ones": np.ones(n, int), "period": np.arange(n) % 3 + 1, "few": rng.integers(1, 250, n)}[kind]
        want = np.argsort(np.array(sorted(range(n), key=lambda i: s[i:].tolist()), int))  # noqa: B023
        assert ranks(s, 1 << 60).tolist() == want.tolist()


def test_same_prefixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    for length in (3, 8, 13):
        starts = np.arange(len(data) - length + 1)
        label = same_prefixes(data, starts, length)
        parts = [data[k : k + length].tobytes() for k in starts]
        assert len(set(zip(label.tolist(), parts, strict=True))) == len(set(parts)) == len(set(label.tolist()))


def test_groups_beyond_the_suffix_order(monkeypatch):
    """More symbols than one order takes: the same classes, also where hashes clash."""
    from locuspark.llm import difference_cover, tokens

    line = np.frombuffer(b"one line of sixty bytes that stands in the text again and...", np.uint8)
    data = np.tile(line, difference_cover.LONGEST // len(line) + 2)
    starts = np.arange(0, len(data) - 50, 997)
    label = same_prefixes(data, starts, 50)
    first = {}
    assert all(first.setdefault(data[s : s + 50].tobytes(), k) == k for s, k in zip(starts.tolist(), label.tolist(), strict=True))
    assert len(set(first.values())) == len(first)
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(tokens, "mixed", lambda x: x & np.uint64(1))
        for length in (3, 9):
            small = np.frombuffer(b"abcabcabdabcabcabdxyzabcab" * 4, np.uint8)
            at = np.arange(len(small) - length)
            got, want = difference_cover.same_windows(small, at, length, 7), same_prefixes(small, at, length)
            assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(got.tolist())) == len(set(want.tolist()))


def test_colliding_hashes(spark, monkeypatch):
    """Claims hold by their bytes only: where hashes collide, none that is wrong does."""
    import pyarrow as pa

    rng = random.Random(6)
    line = "a line of more than fifty bytes which is the same for all of them, "
    texts = [line + "".join(rng.choice("ab") for _ in range(70)) for _ in range(12)]
    col = pa.array(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([0] * 12, pa.int32()), col], names=["doc_id", "sub", "text"])
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)

    class Colliding(suffix_dedup.Contexts):
        def __init__(self, *args, **kw):
            super().__init__(*args, **kw)
            self.hash = self.hash & np.uint64(0)

    monkeypatch.setattr(suffix_dedup, "Contexts", Colliding)
    for batch_size in (10**6, 1):  # settled in a batch, or by claims
        monkeypatch.setattr(suffix_dedup, "BATCH", batch_size)
        batches = [batch.slice(k, 1) for k in range(12)]
        by_bucket = lambda made: iter(sorted(made, key=lambda b: b.column("bucket")[0].as_py()))
        rows = lambda made: [b.slice(k, 1) for b in made for k in range(b.num_rows)]
        found = rows(suffix_dedup._settle(4096, 3)(by_bucket(rows(suffix_dedup._deal(50, 20, 3, np.zeros(0, np.uint64))(iter(batches))))))
        told = {r["doc_id"]: r["found"] for b in suffix_dedup._collect(False)(by_bucket(found)) for r in b.to_pylist()}
        asked = [pa.RecordBatch.from_arrays([*next(suffix_dedup._travelling(iter([batches[i]]))).columns, pa.array([told.get(i)], pa.binary())], names=["doc_id", "sub", "text", "found"]) for i in range(12)]
        fetched = rows(suffix_dedup._fetch(50, 20, 3, np.zeros(0, np.uint64))(iter(asked)))
        answers = rows(suffix_dedup._order(50, 10**6, 3)(by_bucket(fetched)))
        plain = suffix_dedup.Contexts(*suffix_dedup.raw(col), 50, 20)
        failing = sum(b.column("kind")[0].as_py() == suffix_dedup.FAILED for b in answers)
        holding = [(r["doc_id"], o >> 3) for b in suffix_dedup._collect(True)(by_bucket([*found, *answers])) for r in b.to_pylist() for o in np.frombuffer(r["found"] or b"", "<i8").tolist()]
        assert holding and (failing or batch_size > 1)
        for i, o in holding:
            at = plain.first[i] + o
            for w in range(int(plain.lo[at] - plain.off[i]), int(plain.hi[at] - plain.off[i]) + 1):
                assert first[texts[i][w : w + 50]] < i


def test_failed_claims_start_again(spark, monkeypatch):
    """After a failed claim all is done with another root, and the answer is right."""
    rows = random_rows(9)
    roots, real = [], suffix_dedup.hot_grams
    monkeypatch.setattr(suffix_dedup, "hot_grams", lambda *a: (roots.append(a[-1]), real(*a))[1])
    order = suffix_dedup._order

    def failing(length, chunk, buckets):
        import pyarrow as pa

        run = order(length, chunk, buckets)
        return (lambda it: (b.set_column(1, "kind", pa.array([2] * b.num_rows, pa.int32())) for b in run(it))) if len(roots) == 1 else run

    monkeypatch.setattr(suffix_dedup, "_order", failing)
    got = suffix_dedup.deduplicated(table(spark, rows), 8, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, 8) and len(set(roots)) == 2
    with pytest.raises(ValueError, match="integer"):
        suffix_dedup.deduplicated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
