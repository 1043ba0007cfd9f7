"""The distributed difference cover against sorted suffixes and against all windows."""

import random

import numpy as np
import pytest
from corpus import table
from test_suffix_dedup import expected, random_rows

from locuspark.llm import distributed_order as D


@pytest.mark.parametrize("enough", [2, 1 << 40])
def test_ranks(spark, enough):
    """Ranks are the order of all suffixes of all strings; a cut order is right in its first symbols."""
    rng = random.Random(1)
    strings = [[rng.randrange(1, 4) for _ in range(rng.randrange(0, 14))] for _ in range(12)] + [[1] * 10, [2, 1] * 5, [3]]
    frame = spark.createDataFrame([(k, np.array(s, np.int64).tobytes()) for k, s in enumerate(strings)], "doc long, s binary")
    got = {r["doc"]: np.frombuffer(r["s"], np.int64).tolist() for r in D.ranks(frame, enough).collect()}
    suffixes = [(got[k][i], s[i:]) for k, s in enumerate(strings) for i in range(len(s))]
    for a, x in suffixes:
        for b, y in suffixes:
            if enough > 99:
                assert x == y or (a < b) == (x < y)  # whole suffixes that are equal may come in any order
            elif x[:enough] != y[:enough]:
                assert (a < b) == (x < y)


@pytest.mark.parametrize(("seed", "length"), [(1, 8)])
def test_against_brute_force(spark, seed, length):
    rows = [*{i: (i, t) for i, t in random_rows(seed, 25)}.values(), (300, None), (301, ""), (302, "short")]
    got = D.deduplicated(table(spark, rows), length)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, length)
