import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import awkward, table

from locuspark.llm import classify, features
from locuspark.llm.models import FactorizationMachine, NaiveBayesSupportVectors

SF = "/root/testdata/sf0.01"


def rows_of(lists):
    return np.array([x for r in lists for x in r], np.int32), np.concatenate([[0], np.cumsum([len(r) for r in lists])])


def test_log_count_ratios():
    idx, at = rows_of([[0, 1], [0, 2], [2], [2, 3]])
    m = NaiveBayesSupportVectors(6).fit(idx, at, np.array([1, 1, 0, 0]))
    pos, neg = np.array([3, 2, 2, 1.0]), np.array([1, 1, 3, 2.0])  # counts and one, of the features that occur
    assert np.allclose(m.ratio[:4], np.log((pos / pos.sum()) / (neg / neg.sum()))) and (m.ratio[4:] == 0).all()


def test_dual_solution_is_optimal():
    """No step away from the solution lowers the primal objective."""
    rng = np.random.default_rng(3)
    lists = [sorted(set(rng.integers(0, 30, 8).tolist())) for _ in range(80)]
    y = np.array([int(sum(r) + rng.normal(0, 30) > 115) for r in lists])
    idx, at = rows_of(lists)
    m = NaiveBayesSupportVectors(30, epochs=3000).fit(idx, at, y)
    x = np.zeros((80, 31))
    for k, r in enumerate(lists):
        v = m.ratio[r]
        x[k, r], x[k, 30] = v / np.sqrt((v * v).sum()), 1
    sign, n = np.where(y > 0, 1.0, -1.0), len(y)
    box = m.c * np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y == 0).sum()))
    w = np.append(np.divide(m.weight.astype(float), m.ratio, out=np.zeros(30), where=m.ratio != 0), m.bias)
    value = lambda u: 0.5 * u @ u + (box * np.maximum(0, 1 - sign * (x @ u))).sum()
    best = value(w)
    assert all(value(w + rng.normal(0, s, 31)) > best - 1e-2 for s in (1e-3, 1e-2, 1e-1, 1) for _ in range(50))
    assert np.allclose(m.margin(idx, at), x @ w, atol=1e-5)


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = FactorizationMachine(50)
    m.scale = rng.uniform(0.1, 1, 50).astype(np.float32)
    m.w, m.v, m.bias = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32), 0.3
    idx, at = rows_of([[1, 4, 9], [], [7], [2, 3, 5, 8, 13]])
    got = m.margin(idx, at)
    for k in range(4):
        own = idx[at[k] : at[k + 1]]
        norm = sum(float(m.scale[i]) ** 2 for i in own) ** 0.5
        x = {i: m.scale[i] / norm for i in own}
        want = 0.3 + sum(m.w[i] * x[i] for i in own) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for p, i in enumerate(own) for j in own[p + 1 :])
        assert got[k] == pytest.approx(want, abs=1e-4)


def test_interactions():
    """An insult counts with a group mention only, or terms only by whether they meet: the default model learns it, additive weights cannot."""
    rng = np.random.default_rng(6)
    n = 3000
    a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
    lists = [sorted({a[k], 2 + b[k], *rng.integers(4, 40, 6)}) for k in range(n)]
    for y, linear in (((a == b).astype(int), 0.6), (a & b, 0.99)):
        train, rest = (rows_of([lists[k] for k in part]) for part in (range(2000), range(2000, n)))
        m = FactorizationMachine(64).fit(*train, y[:2000])
        assert ((m.score(*rest) > 0.5) == y[2000:]).mean() > 0.97
        m.v[:] = 0
        assert ((m.score(*rest) > 0.5) == y[2000:]).mean() < linear


def test_every_term_learns():
    """No bucket of the training rows is left out, however many there are."""
    rng = np.random.default_rng(2)
    lists = [sorted(set(rng.integers(0, 30_000, 60).tolist())) for _ in range(1500)]
    idx, at = rows_of(lists)
    m = FactorizationMachine(1 << 15).fit(idx, at, rng.integers(0, 2, 1500))
    seen = np.unique(idx)
    assert (m.scale[seen] > 0).all() and (m.w[seen] != 0).mean() > 0.99 and (m.scale[np.setdiff1d(np.arange(1 << 15), seen)] == 0).all()


@pytest.mark.parametrize("model", [NaiveBayesSupportVectors, FactorizationMachine])
def test_degenerate_labels(model):
    idx, at = rows_of([[1], [2]])
    assert model(8).fit(idx[:0], at[:1], np.zeros(0, int)).score(idx, at).tolist() == [0.5, 0.5]
    assert (model(8).fit(idx, at, np.array([1, 1])).score(idx, at) > 0.9).all() and (model(8).fit(idx, at, np.array([0, 0])).score(idx, at) < 0.1).all()


def test_features_by_document():
    texts = ["One two THREE!", "", None, "one one two", "é1 longerwordhere, 2024"]
    for make in (features.style, features.terms):
        idx, at = make(pa.array(texts), 1 << 18)
        for k, t in enumerate(texts):
            alone, _ = make(pa.array([t], pa.string()), 1 << 18)
            assert sorted(idx[at[k] : at[k + 1]].tolist()) == sorted(alone.tolist())
        assert at[2] == at[1] and at[3] == at[2]


@pytest.mark.parametrize(("name", "label", "threshold"), [("quality", "quality", 0.5), ("toxicity", "toxic", 0.7)])
def test_held_out_accuracy(spark, name, label, threshold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = getattr(classify, name)(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    all_rows = got.toPandas()
    assert len(all_rows) == docs.count() and all_rows.score.between(0, 1).all() and ((all_rows.score >= threshold) == (all_rows.predicted == 1)).all()
    assert (all_rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in all_rows.doc_id]).all()
    rows = all_rows[all_rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (rows.predicted == rows[label]).mean() > 0.95
    # held-out labels, and those columns that are no inputs, change nothing
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % 3 = 1, 1 - {label}, {label}) as {label}")
    again = getattr(classify, name)(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "1 as score"), flipped).toPandas()
    assert all_rows.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_bounded_sample(spark):
    labels = spark.createDataFrame([(k, k % 4 == 0, 0) for k in range(300)], "doc_id long, flag boolean, toxic int").selectExpr("doc_id", "int(flag) as quality", "toxic")
    ids = classify.training_ids(labels, "quality", 10).collect()
    assert len(ids) == 20 and sum(r["y"] for r in ids) == 10 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in ids)
    assert {r["doc_id"] for r in ids} == {r["doc_id"] for r in classify.training_ids(labels.repartition(7), "quality", 10).collect()}


def test_awkward_tables(spark):
    docs = table(spark, awkward(), clashing=True)
    labels = spark.createDataFrame([(5, 0, 0), (9, 1, 1), (9, 0, 1), (10, None, None), (None, 1, 1), (7, 7, 0), (12, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (classify.quality, classify.toxicity):
        for given in (labels, labels.limit(0)):
            got = run(docs, given).collect()
            assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert run(table(spark, []), labels).count() == 0
    kept = classify.accepted(docs, labels)
    scores = classify.quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scores.where("predicted = 1").count()


def test_toxic_recall_and_pairs(spark):
    """Held-out recall at the production threshold, and what is left of it without the pairs."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = classify.toxicity_model(docs, labels)

    def rates():
        rows = classify.scored(docs, model, features.terms, 0.7).where("held_out").join(labels, "doc_id").toPandas()
        return (rows.predicted[rows.toxic == 1]).mean(), (rows.predicted[rows.toxic == 0]).mean()

    recall, alarms = rates()
    assert recall >= 0.9 and alarms <= 0.005
    model.v[:] = 0
    assert rates()[0] < recall - 0.1
