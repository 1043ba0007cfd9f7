import random
from itertools import combinations

import pytest
from corpus import awkward, table, words

from locuspark.llm import decontaminate as D


def overlaps(doc, item, window=D.WINDOW, share=D.SHARE):
    """All ungapped alignments: whether some window of the item agrees in enough tokens."""
    m = min(window, len(item))
    for s in range(-len(item) + m, len(doc) - m + 1):
        same = [0 <= s + k < len(doc) and doc[s + k] == item[k] for k in range(len(item))]
        for a in range(len(item) - m + 1):
            if s + a >= 0 and s + a + m <= len(doc) and sum(same[a : a + m]) + 1e-9 >= share * m:
                return True
    return False


def made(seed):
    rng = random.Random(seed)
    items = [words(rng, n, 60) for n in (3, 5, 6, 9, 14, 19, 20, 21, 27, 40, 60)]
    docs = []
    for _ in range(120):
        doc = words(rng, rng.randrange(0, 90), 60)
        if rng.random() < 0.7:
            part = list(rng.choice(items))
            a = rng.randrange(max(1, len(part) - 19))
            part = part[a : a + rng.randrange(15, 45)]
            for k in range(len(part)):
                if rng.random() < rng.choice((0, 0.1, 0.2, 0.3)):
                    part[k] = "subst"
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = part
        docs.append(doc)
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(1, 1_000_000), (2, 40)])
def test_against_all_alignments(spark, seed, block):
    docs, items = made(seed)
    bench = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(items)] + [(None, "no id here at all you see", "y"), (99, None, "z"), (0, " ".join(items[0]), "x")], "item_id long, text string, doc_id string")
    frame = table(spark, [(k, ", ".join(d).upper()) for k, d in enumerate(docs)], clashing=True)
    want = {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) if len(t) >= D.LEAST and overlaps(d, t)}
    rows = D.contaminated(frame, bench, most=block).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want) > 20
    for r in rows:
        text = ", ".join(docs[r["doc_id"]]).upper().encode()
        span = text[r["byte_start"] : r["byte_end"]].decode().lower().split(", ")
        assert len(span) >= r["n_window"] and r["n_matched"] + 1e-9 >= D.SHARE * r["n_window"] and overlaps(span, items[r["item_id"]])
    kept = D.decontaminated(frame, bench, most=block)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(docs))) - {i for i, _ in want})


def test_seeds_are_lossless():
    """However four of twenty tokens are substituted, a mask survives; so it is for shorter items."""
    for wrong in combinations(range(20), 4):
        assert any(all(o + a not in wrong for o in mask) for mask in D.MASKS for a in range(20 - mask[-1]))
    for n in range(D.LEAST, 20):
        (mask,) = D.seeds_for(n)
        bad = n - -(-4 * n // 5)
        for wrong in combinations(range(n), bad):
            assert any(all(o + a not in wrong for o in mask) for a in range(n - mask[-1]))


def test_awkward_tables(spark):
    bench = spark.createDataFrame([(1, "another text with the same id")], "item_id long, text string")
    frame = table(spark, awkward(), clashing=True)
    assert [r["doc_id"] for r in D.contaminated(frame, bench).collect()] == [11]
    assert D.decontaminated(frame, bench).count() == len(awkward()) - 1
    empty = bench.limit(0)
    assert D.contaminated(frame, empty).count() == 0 and D.decontaminated(frame, empty).count() == len(awkward()) and D.contaminated(frame, empty).columns == D.contaminated(frame, bench).columns
    assert D.contaminated(table(spark, []), bench).count() == 0


def test_repetitive_text(spark):
    """One token over and over, in a long document and in an item: bounded pieces, the right answer."""
    import time

    bench = spark.createDataFrame([("loop", "a " * 60), ("pair", "a b " * 30), ("short", "lone words")], "item_id string, text string")
    frame = table(spark, [(1, "a " * 80_000), (2, "b a " * 200), (3, "c " * 5000), (4, "some lone words"), (5, "a " * 12)])
    began = time.time()
    got = D.contaminated(frame, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, "loop"), (2, "pair")] and time.time() - began < 20
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(frame, bench, least=1).collect()} == {(1, "loop"), (2, "pair"), (4, "short")}


def test_pieces_of_hits(monkeypatch):
    """However few hits are held at once, the rows are the same."""
    import numpy as np
    import pyarrow as pa

    from locuspark.llm.tokens import Runs, raw

    docs, items = made(5)
    hashes = lambda parts: Runs(*raw(pa.array([" ".join(p) for p in parts])))
    index = D.Index([(k, hashes([t]).words()) for k, t in enumerate(items)])
    runs = hashes(docs)
    want = list(index.find(runs.words(), runs.bounds(len(docs))))
    monkeypatch.setattr(D, "PAIRS", 7)
    assert want and list(index.find(runs.words(), runs.bounds(len(docs)))) == want and np.ndim(index.sieve) == 1
