"""The corpus pipeline: each stage on its own input, and the whole."""

import corpus_pipeline as C
import pytest
from corpus import awkward, table
from test_similar import expected

from locuspark.llm import classify, decontaminate, registry, secrets
from locuspark.llm.frames import drop_written, shared_dir, unused, written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        made = written(stage(spark, docs, SF), name)
        out.append((name, docs, made))
        docs = made
    return out


def test_stages(spark, stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    for _, docs, made in stages[:-1]:
        assert made.columns == COLUMNS == docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    (_, docs, good), (_, _, single), (_, _, clean), (_, _, safe), (_, _, packed) = stages
    scores = classify.quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(scores.where("predicted = 1"))
    assert ids(single) == sorted({c for _, c in expected([(r["doc_id"], r["text"]) for r in good.collect()])})
    leaks = decontaminate.contaminated(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(clean) == sorted(set(ids(single)) - set(ids(leaks))) and leaks.count() > 0
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == {i: secrets.redacted(t) for i, t in texts.items()} and ids(safe) == ids(clean)
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids(safe)


def test_run(spark, stages):
    assert sorted(map(tuple, C.run(spark, SF).collect()), key=repr) == sorted(map(tuple, stages[-1][2].collect()), key=repr)


def test_awkward_documents(spark):
    """Every stage takes tables with nulls, odd names and no rows."""
    for rows in (awkward(), []):
        docs = table(spark, rows, clashing=True)
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0
            docs = docs if name == "packing" else out


def test_registry(spark):
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_written_tables(spark):
    df = written(spark.range(5), "test")
    (folder,) = {f.rpartition("/")[0] for f in df.inputFiles()}
    assert df.count() == 5 and shared_dir(spark).removeprefix("file:").strip("/") in folder
    drop_written(df)
    with pytest.raises(Exception, match="locuspark-test"):
        df.count()
    assert unused(spark.range(1).selectExpr("id as A", "id as a_"), "a") == "a__"
