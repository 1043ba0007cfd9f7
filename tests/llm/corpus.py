"""Small corpora for the tests of the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; here they are columns of the table.
CLASHING = ("fp", "key", "root", "node", "least", "component_id", "block", "ahead", "sub", "found", "single", "payload", "bucket", "score", "score_", "y", "idx", "held_out", "predicted", "spans", "n_tokens", "salt", "fingerprint", "item_id", "a", "b", "count", "_id", "license", "odd name.with dot")


def table(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    """``rows`` of (doc_id, text) as a documents table; ``clashing``: with more columns of awkward names."""
    extra = "".join(f", `{c}` string" for c in CLASHING) if clashing else ""
    data = [(i, t, None, None if k % 2 else "s", None if t is None or k % 3 == 0 else len(t), *(["x"] * len(CLASHING) if clashing else [])) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS + extra)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward() -> list[tuple]:
    """Null ids and texts, empty and very long texts, repeated rows, repeated ids, non-ASCII."""
    long = " ".join(words(random.Random(1), 30_000))
    return [(5, None), (None, "a text without an id and some more words"), (None, None), (7, ""), (8, " \t\n "), (9, long), (9, long), (10, long + " end"), (11, "ein überlanges Wört " + "é" * 5000), (11, "another text with the same id"), (12, "x"), (13, "\x00 nul and \U0001f600 smile")]


def groups(pairs, items):
    """Smallest member of each item's connected component."""
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}
