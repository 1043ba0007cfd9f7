"""A variant model computed from an ``orders`` table, for tests and benchmarks.

With k the order key, i a sample and p a ploidy slot, everything is integer
arithmetic, so that any SQL engine can derive the same variants.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from locuspark.model import Field, VariantSet

SAMPLES = tuple(f"S{i:02d}" for i in range(12))
PER_CONTIG = 3000


def derived(spark: SparkSession, sf_dir: str, stored_an: bool = False) -> VariantSet:
    """Variants of ``orders`` under ``sf_dir``; ``stored_an`` adds an INFO/AN that disagrees with the genotypes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    # One expression a sample: a lambda over samples would be interpreted, while these become code.
    each = lambda expr: F.expr("array(" + ", ".join(expr(i) for i in range(len(SAMPLES))) + ")")
    slot = lambda i, p: f"if((o_orderkey * 7 + {i * 13}) % 11 = 0, null, cast((o_orderkey * 31 + {i * 17 + p * 5}) % (2 + o_orderkey % 3) as tinyint))"

    def call(i: int) -> str:
        # The first sample keeps a lambda, which leaves the projection out of the stage's one method: that would be too long to be compiled.
        two = f"array({slot(i, 0)}, {slot(i, 1)})"
        return f"if((o_orderkey + {i}) % 17 = 0, array({slot(i, 0)}), {two if i else f'transform({two}, x -> x)'})"

    ref = "substr('ACGTACGT', cast(1 + o_orderkey % 4 as int), if(o_orderkey % 7 = 3, 2, 1))"
    alt = f"""case (o_orderkey + j) % 8 when 4 then '*' when 5 then '<*>' when 6 then concat({ref}, 'T') when 7 then 'ACGTA'
        when 1 then concat(substr({ref}, 1, length({ref}) - 1), substr('ACGT', cast(1 + (o_orderkey + j + length({ref}) - 1) % 4 as int), 1))
        else substr('ACGTACGT', cast(1 + (o_orderkey + j) % 4 as int), length({ref})) end"""
    df = orders.select(
        k.cast("long").alias("variant_index"),
        F.expr(f"concat('c', cast(o_orderkey div {PER_CONTIG} as string))").alias("chrom"),
        F.expr(f"cast(1 + (o_orderkey % {PER_CONTIG}) * 10 + o_orderkey % 7 as bigint)").alias("pos"),
        F.expr("cast(1 + o_orderkey % 4 as int)").alias("rlen"),
        F.expr("if(o_orderkey % 6 = 1, null, concat('v', cast(o_orderkey as string)))").alias("id"),
        F.expr(ref).alias("ref"),
        F.expr(f"transform(sequence(1, cast(1 + o_orderkey % 3 as int)), j -> {alt})").alias("alts"),
        F.expr("if(o_orderkey % 13 = 0, null, cast(o_totalprice as double))").alias("qual"),
        F.expr("case when o_orderkey % 9 = 0 then array('q10', 's50') when o_orderstatus = 'F' then array('PASS') when o_orderstatus = 'O' then array('q10') else cast(array() as array<string>) end").alias("filters"),
        F.expr("if(o_orderkey % 10 = 3, null, cast(o_custkey % 101 as int))").alias("info_DP"),
        F.expr("transform(sequence(1, cast(1 + o_orderkey % 3 as int)), j -> if((o_orderkey + j) % 6 = 0, null, cast((o_orderkey * 3 + j * 7) % 12 as int)))").alias("info_XA"),
        F.expr("array(cast(o_orderkey % 5 as int), cast((o_orderkey + 3) % 7 as int))").alias("info_XP"),
        F.expr("o_orderkey % 4 = 0").alias("info_DB"),
        *([F.expr("cast(24 - o_orderkey % 5 as int)").alias("info_AN")] if stored_an else []),
        each(call).alias("gt"),
        each(lambda i: f"(o_orderkey + {i}) % 3 != 0").alias("phased"),
        each(lambda i: f"if((o_orderkey * 3 + {i * 7}) % 19 = 0, null, cast((o_orderkey * 5 + {i * 11}) % 40 as int))").alias("fmt_DP"),
        each(lambda i: f"if((o_orderkey * 11 + {i * 5}) % 23 = 0, null, cast((o_orderkey * 7 + {i * 29}) % 100 as int))").alias("fmt_GQ"),
    )
    top = orders.agg(F.max("o_orderkey")).first()[0]
    contigs = tuple(f"c{c}" for c in range(max(8, (top or 0) // PER_CONTIG + 1)))  # a header may name more than there are
    fields = [Field("INFO", "DP", description="Total depth"), Field("INFO", "XA", "A", width=3), Field("INFO", "XP", "2", width=2), Field("INFO", "DB", "0", "Flag"), Field("FORMAT", "DP"), Field("FORMAT", "GQ")]
    if stored_an:
        fields.append(Field("INFO", "AN"))
    return VariantSet(df, SAMPLES, contigs, ("PASS", "q10", "s50"), tuple(fields), max_alleles=4, max_rlen=4, source="orders")
