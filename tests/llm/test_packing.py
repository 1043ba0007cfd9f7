import random
from collections import defaultdict

import pytest
from corpus import awkward, table, words

from locuspark.llm import packing as P


def checked(rows, docs_tokens, lengths):
    """Pieces tile their documents, bins hold them side by side, and no smaller permitted length would do."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        if r["bin_id"] is not None:
            by_bin[r["bin_id"]].append(r)
    for i, n in docs_tokens.items():
        own = sorted(by_doc[i], key=lambda r: r["token_start"])
        assert sum(r["n_tokens"] for r in own) == n and [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["token_start"] == at and r["n_tokens"] <= max(lengths) and (r["bin_id"] is None) == (r["n_tokens"] == 0)
            at += r["n_tokens"]
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        (capacity,) = {r["capacity"] for r in own}
        assert capacity == min(c for c in lengths if c >= at)
    return by_bin


def test_packed(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(words(rng, rng.choice((3, 50, 300, 900, 5000))))) for k in range(200)]
    lengths = (256, 512, 1024, 2048)
    got = P.packed(table(spark, rows, clashing=True), lengths, block_tokens=60_000).collect()
    bins = checked(got, {i: len(t.split()) for i, t in rows}, lengths)
    used = sum(r["n_tokens"] for r in got)
    assert sum(own[0]["capacity"] for own in bins.values()) < 1.1 * used
    again = P.packed(table(spark, rows[::-1]).repartition(5), lengths, block_tokens=60_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_joint_lengths_cost_no_more_than_one():
    rng = random.Random(5)
    for _ in range(20):
        sizes = sorted((rng.randrange(1, 2000) for _ in range(rng.randrange(1, 120))), reverse=True)
        lengths = (128, 512, 2048)
        place, offset, caps, total = P.pack(sizes, lengths)
        assert total == pytest.approx(sum(P.cost(c, 2048) for c in caps)) and len(place) == len(sizes) == len(offset)
        single, _, filled = P._pack(sizes, lengths, lambda n, left: 2048)
        assert total <= sum(P.cost(2048, 2048) for _ in filled) and single
        assert sum(caps) >= sum(sizes)


def test_best_fit_takes_the_tightest_bin():
    place, offset, filled = P._pack([60, 50, 40, 30], (100,), lambda n, left: 100)
    assert place == [0, 1, 0, 1] and offset == [0, 0, 60, 50] and filled == [100, 80]


def naive(sizes, opened):
    """Best fit by looking at every bin: of those with the least room that is enough, the last opened or freed."""
    bins, total, out = [], sum(sizes), []
    for t, n in enumerate(sizes):
        fits = [(room - used, -when, b) for b, (room, used, when) in enumerate(bins) if used + n <= room]
        if fits:
            b = min(fits)[2]
            bins[b] = (bins[b][0], bins[b][1] + n, t)
        else:
            b = len(bins)
            bins.append((opened(n, total), n, t))
        total -= n
        out.append(b)
    return out, [used for _, used, _ in bins]


def test_against_naive_best_fit():
    rng = random.Random(11)
    for _ in range(60):
        lengths = tuple(sorted(rng.sample(range(5, 200), 3)))
        sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(1, 80))), reverse=True)
        rule = lambda n, left: rng_choice(n, lengths)  # noqa: B023, E731
        rng_choice = lambda n, lengths: max(c for c in lengths if c >= n) if n % 2 else min(c for c in lengths if c >= n)
        place, offset, filled = P._pack(sizes, lengths, rule)
        want, used = naive(sizes, rule)
        assert place == want and filled == used


def optimum(sizes, lengths):
    """The least cost over all ways to put ``sizes`` into bins."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(sizes):
            best[0] = min(best[0], sum(P.cost(min(c for c in lengths if c >= b), lengths[-1]) for b in bins))
            return
        for b in {b: i for i, b in enumerate(bins)}.values():
            if bins[b] + sizes[k] <= lengths[-1]:
                go(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def test_near_the_optimum():
    """On small inputs the cost is never below the least possible one, and close to it."""
    rng, ratio = random.Random(13), []
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 100) for _ in range(rng.randrange(1, 8))), reverse=True)
        ratio.append(P.pack(sizes, (25, 50, 100))[3] / optimum(sizes, (25, 50, 100)))
    assert min(ratio) >= 1 - 1e-9 and max(ratio) < 1.35 and sum(ratio) / len(ratio) < 1.05


def test_blocks_are_bounded(spark):
    """Neither tiny texts nor equal rows fill one task."""
    docs = table(spark, [(1, "same words")] * 3000 + [(k, "x") for k in range(2, 3000)] + [(k, "") for k in range(5000, 6000)])
    got = P.packed(docs, (8, 16), block_rows=500).toPandas()
    sizes = got[got.n_tokens > 0].groupby(got.bin_id // (1 << 32)).size()
    assert len(got) == 3000 + 2998 + 1000 and (got.doc_id == 1).sum() == 3000 and len(sizes) == 12 and sizes.max() < 700
    assert (got[got.n_tokens == 0].doc_id >= 5000).all()


def test_awkward_tables(spark):
    rows = awkward()
    got = P.packed(table(spark, rows, clashing=True)).collect()
    empty = [r for r in got if r["n_tokens"] == 0]
    assert len(empty) == 4 and all(r["bin_id"] is None and r["capacity"] is None for r in empty)
    counts = {r["doc_id"]: 0 for r in got}
    for r in got:
        counts[r["doc_id"]] += r["n_tokens"]
    assert counts[9] == 2 * 30_000 and counts[10] == 30_001 and counts[None] == 9
    assert P.packed(table(spark, [])).count() == 0


def test_public_tokenizer(spark):
    path = pytest.importorskip("pathlib").Path("/opt/tokenizers")
    files = sorted(path.glob("*.tiktoken"))
    if not files:
        pytest.skip("no rank file")
    rows = [(1, "some plain words, and more"), (2, None), (3, "naïve " * 40)]
    got = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(table(spark, rows), str(files[0])).collect()}
    enc = P.encoder(str(files[0]), P.PATTERN)
    assert got == {1: len(enc.encode_ordinary(rows[0][1])), 2: 0, 3: len(enc.encode_ordinary(rows[2][1]))}
