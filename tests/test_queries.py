"""Every registered variant query against its SQL on the smallest tables."""

import duckdb
import pytest

from locuspark import queries as Q
from locuspark.sinks.ordered import running
from locuspark.sources.derived import derived

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, db, name):
    fn, sql = Q.QUERIES[name]
    assert rows(fn(spark, SF).toPandas()) == rows(db.execute(sql).df())


def test_entry(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and E.entry(spark).count() > 0


def test_running_sums(spark, monkeypatch):
    from locuspark.sinks import ordered

    monkeypatch.setattr(ordered, "GROUP", 7)
    got = running(spark.range(50).selectExpr("id * 3 as variant_index", "id as n"), "n", "before", 4).orderBy("variant_index").collect()
    assert [r["before"] for r in got] == [4 + k * (k - 1) // 2 for k in range(50)]


def test_no_shuffle_in_row_queries(spark):
    """Filters, formats and records are narrow: nothing is exchanged before the sink orders rows."""
    from locuspark.sinks import vcf

    for df in (Q.query_gt(spark, SF), Q.QUERIES["filter_and_any_sample"][0](spark, SF), Q.bed_codes(spark, SF), vcf.lines(derived(spark, SF))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_computed_fields_share_genotypes(spark):
    """A filter on several computed fields evaluates genotypes and ALTs once a row, not for each field or slot."""
    plan = Q.QUERIES["filter_computed"][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("+ 192)") == 1 and plan.count("<*>") == 1

    def kept(*texts):
        vs = derived(spark, SF)
        for text in texts:
            vs = vs.with_filter(text)
        return sorted(r["variant_index"] for r in vs.result().select("variant_index").collect())

    assert kept("POS > 5000 && AC > 7 && AN < 22") == kept("POS > 5000", "AC > 7 && AN < 22") != []


def test_write_computes_rows_once(spark, tmp_path):
    """A set is written in disjoint ranges of variant_index, and its rows are not computed first to find these."""
    from pyspark.sql import functions as F

    from locuspark.sources import tables

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(30000).selectExpr("if(id < 20000, 29999 - id, 1000000 + id) as variant_index", "'c' as chrom", "id as pos", "'A' as ref", "array('C') as alts")
    tables.write(tables.from_frame(rows.withColumn("id", F.udf(counted, "long")("pos")), (), ("c",)), str(tmp_path))
    back = tables.read(spark, str(tmp_path)).df
    spans = sorted(tuple(r)[1:] for r in back.groupBy(F.input_file_name()).agg(F.min("variant_index"), F.max("variant_index")).collect())
    assert seen.value == 30000 == back.select("variant_index").distinct().count() and len(spans) > 1
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
