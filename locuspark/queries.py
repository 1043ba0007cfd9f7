"""The driver's queries over the variant model of ``sources.derived``, each with SQL over long tables.

The Spark side works on wide arrays; the SQL side crosses variants with
samples, slots and ALTs and groups again, so that the two share no logic.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.functions import derived as D
from locuspark.functions.binding import names
from locuspark.model import VariantSet
from locuspark.operators.stats import contig_counts
from locuspark.plans import expression as X
from locuspark.plans.formats import formatted
from locuspark.plans.resolve import info, project, result
from locuspark.sinks import bgen, plink, vcf
from locuspark.sinks.random_access import BedEncoder
from locuspark.sources import tables
from locuspark.sources import vcf as vcf_source
from locuspark.sources.derived import SAMPLES, derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

N = len(SAMPLES)
MODEL = f"""
v AS (SELECT o_orderkey AS k, 'c' || (o_orderkey // 3000) AS chrom, 1 + (o_orderkey % 3000) * 10 + o_orderkey % 7 AS pos, 1 + o_orderkey % 4 AS rlen,
    CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE 'v' || o_orderkey END AS id, substr('ACGTACGT', CAST(1 + o_orderkey % 4 AS INT), CASE WHEN o_orderkey % 7 = 3 THEN 2 ELSE 1 END) AS ref,
    1 + o_orderkey % 3 AS n_alt, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS qual,
    CASE WHEN o_orderkey % 9 = 0 THEN ['q10', 's50'] WHEN o_orderstatus = 'F' THEN ['PASS'] WHEN o_orderstatus = 'O' THEN ['q10'] ELSE CAST([] AS VARCHAR[]) END AS filters,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_custkey % 101 END AS dp, o_orderkey % 4 = 0 AS db FROM orders),
a AS (SELECT k, j, n_alt, dp, CASE (k + j) % 8 WHEN 4 THEN '*' WHEN 5 THEN '<*>' WHEN 6 THEN ref || 'T' WHEN 7 THEN 'ACGTA'
      WHEN 1 THEN substr(ref, 1, length(ref) - 1) || substr('ACGT', CAST(1 + (k + j + length(ref) - 1) % 4 AS INT), 1) ELSE substr('ACGTACGT', CAST(1 + (k + j) % 4 AS INT), length(ref)) END AS alt,
    ref, CASE WHEN (k + j) % 6 = 0 THEN NULL ELSE (k * 3 + j * 7) % 12 END AS xa FROM v, range(1, 4) r(j) WHERE j <= n_alt),
t AS (SELECT k, j, CASE WHEN alt = '<*>' THEN 'ref' WHEN length(ref) = 1 AND length(alt) = 1 THEN CASE WHEN ref = alt THEN 'ref' WHEN alt = '*' THEN 'other' ELSE 'snp' END
    WHEN length(ref) > 1 AND length(ref) = length(alt) AND hamming(ref, alt) = 1 THEN 'snp' ELSE 'other' END AS kind FROM a),
c AS (SELECT k, i, (k + i) % 3 <> 0 AS phased, CASE WHEN (k * 3 + i * 7) % 19 = 0 THEN NULL ELSE (k * 5 + i * 11) % 40 END AS cdp, CASE WHEN (k * 11 + i * 5) % 23 = 0 THEN NULL ELSE (k * 7 + i * 29) % 100 END AS gq FROM v, range(0, {N}) s(i)),
g AS (SELECT k, i, p, CASE WHEN (k * 7 + i * 13) % 11 = 0 THEN NULL ELSE (k * 31 + i * 17 + p * 5) % (2 + k % 3) END AS al FROM v, range(0, {N}) s(i), range(0, 2) u(p) WHERE p = 0 OR (k + i) % 17 <> 0),
ac AS (SELECT a.k, a.j, count(g.al) AS n FROM a LEFT JOIN g ON g.k = a.k AND g.al = a.j GROUP BY a.k, a.j),
an AS (SELECT k, count(al) AS an, count(DISTINCT CASE WHEN al IS NOT NULL THEN i END) AS ns FROM g GROUP BY k),
name AS (SELECT i, 'S' || lpad(CAST(i AS VARCHAR), 2, '0') AS sample FROM range(0, {N}) s(i)),
gt AS (SELECT g.k, g.i, CASE WHEN phased THEN string_agg(coalesce(CAST(al AS VARCHAR), '.'), '|' ORDER BY p) ELSE string_agg(coalesce(CAST(al AS VARCHAR), '.'), '/' ORDER BY p) END AS gt FROM g JOIN c ON c.k = g.k AND c.i = g.i GROUP BY g.k, g.i, phased)
"""
MODEL_AND = "WITH " + MODEL + ", "
MODEL_ONLY = "WITH " + MODEL


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/locuspark-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="locuspark-")


def query(sql: str | None, more: str = ""):
    """Registers a query with its SQL over the model; ``more``: further tables."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = (fn, None if sql is None else (MODEL_AND + more + " " + sql if more else MODEL_ONLY + " " + sql))
        return fn

    return add


def _ids(vs: VariantSet) -> DataFrame:
    return result(vs).df.select("variant_index")


def _filters(**cases: tuple[str, bool, str]) -> None:
    """Filter queries: name to (expression, is exclusion, SQL of the indexes that pass)."""
    for name, (text, exclude, sql) in cases.items():

        def run(spark: SparkSession, sf_dir: str, text=text, exclude=exclude) -> DataFrame:
            return _ids(derived(spark, sf_dir).with_filter(**{"exclude" if exclude else "include": text}))

        run.__name__ = name
        query(sql)(run)


_SITE = "SELECT k AS variant_index FROM v WHERE "
_ANY = "SELECT DISTINCT c.k AS variant_index FROM c JOIN v ON v.k = c.k WHERE "
_ALT = "SELECT DISTINCT a.k AS variant_index FROM a WHERE "
_filters(
    filter_arith=("INFO/DP * 2 - 10 > POS / 100", False, _SITE + "dp * 2 - 10 > pos / 100.0"),
    filter_negative=("-INFO/DP < -90", False, _SITE + "-dp < -90"),
    filter_compare=("QUAL > 100000 && INFO/DP >= 50", False, _SITE + "qual > 100000 AND dp >= 50"),
    filter_missing_eq=("INFO/DP = 5", False, _SITE + "dp IS NOT DISTINCT FROM 5"),
    filter_missing_ne=("INFO/DP != 5", False, _SITE + "dp IS DISTINCT FROM 5"),
    filter_both_missing=("FMT/DP = FMT/GQ", False, _ANY + "cdp IS NOT DISTINCT FROM gq"),
    filter_tag_vs_tag=("INFO/DP > FMT/DP & INFO/DP < FMT/GQ", False, _ANY + "dp > cdp AND dp < gq"),
    filter_flag=("INFO/DB", False, _SITE + "db"),
    filter_flag_unset=("INFO/DB = 0 & INFO/DP > 90", False, _SITE + "NOT db AND dp > 90"),
    filter_and_same_sample=("FMT/DP > 30 & FMT/GQ > 80", False, _ANY + "cdp > 30 AND gq > 80"),
    filter_and_any_sample=("FMT/DP > 37 && FMT/GQ > 97", False, "SELECT k AS variant_index FROM c GROUP BY k HAVING bool_or(cdp > 37) AND bool_or(gq > 97)"),
    filter_or_same_sample=("FMT/DP > 38 | FMT/GQ > 98", False, _ANY + "cdp > 38 OR gq > 98"),
    filter_per_allele=("INFO/XA > 5 & INFO/XA < 9", False, _ALT + "xa > 5 AND xa < 9"),
    filter_any_allele=("INFO/XA > 5 && INFO/XA < 3", False, "SELECT k AS variant_index FROM a GROUP BY k HAVING bool_or(xa > 5) AND bool_or(xa < 3)"),
    filter_allele_vs_site=("INFO/XA > INFO/DP", False, _ALT + "xa > dp"),
    filter_mixed_scope=("INFO/XA > 9 & FMT/DP > 35", False, "SELECT k AS variant_index FROM c WHERE cdp > 35 AND k IN (SELECT k FROM a WHERE xa > 9) GROUP BY k"),
    filter_alt_text=('ALT = "*" | REF = "T"', False, "SELECT k AS variant_index FROM v WHERE ref = 'T' OR k IN (SELECT k FROM a WHERE alt = '*')"),
    filter_id=('ID = "v12"', False, _SITE + "id = 'v12'"),
    filter_chrom=('CHROM = "c1" || CHROM = "c3"', False, _SITE + "chrom IN ('c1', 'c3')"),
    filter_chrom_ne=('CHROM != "c0"', False, _SITE + "chrom <> 'c0'"),
    filter_set_eq=('FILTER = "s50;q10"', False, _SITE + "list_sort(filters) = ['q10', 's50']"),
    filter_set_empty=('FILTER = "."', False, _SITE + "len(filters) = 0"),
    filter_set_ne=('FILTER != "q10"', False, _SITE + "filters <> ['q10']"),
    filter_set_superset=('FILTER ~ "q10"', False, _SITE + "list_contains(filters, 'q10')"),
    filter_set_complement=('FILTER !~ "q10"', False, _SITE + "NOT list_contains(filters, 'q10')"),
    filter_type_snp_all=('TYPE = "snp"', False, "SELECT k AS variant_index FROM t GROUP BY k HAVING bool_or(kind = 'snp') AND bool_and(kind IN ('snp', 'ref'))"),
    filter_type_snp_any=('TYPE ~ "snp"', False, "SELECT k AS variant_index FROM t GROUP BY k HAVING bool_or(kind = 'snp')"),
    filter_type_ref=('TYPE = "ref"', False, "SELECT k AS variant_index FROM t GROUP BY k HAVING bool_and(kind = 'ref')"),
    filter_type_not_snp=('TYPE !~ "snp"', False, "SELECT k AS variant_index FROM t GROUP BY k HAVING NOT bool_or(kind = 'snp')"),
    filter_computed=("AC > 7 & AN < 22 & F_MISSING > 0.05", False, "SELECT DISTINCT ac.k AS variant_index FROM ac JOIN an ON an.k = ac.k WHERE n > 7 AND an < 22 AND (12 - ns) / 12.0 > 0.05"),
    exclude_site=("INFO/DP > 20", True, _SITE + "NOT coalesce(dp > 20, false)"),
    exclude_sample=("FMT/DP >= 5", True, _ANY + "NOT coalesce(cdp >= 5, false)"),
    exclude_per_allele=("INFO/XA > 3", True, "SELECT DISTINCT k AS variant_index FROM a WHERE n_alt < 3 OR NOT coalesce(xa > 3, false)"),
)


@query("SELECT k AS variant_index, count(*) AS n_cells FROM c WHERE k IN (SELECT k FROM c WHERE cdp > 38 OR gq > 98) GROUP BY k")
def filter_or_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of a site passes if any does."""
    out = result(derived(spark, sf_dir).with_filter("FMT/DP > 38 || FMT/GQ > 98"))
    return out.df.select("variant_index", F.size(F.filter(out.cells, lambda x: x)).cast("long").alias("n_cells"))


@query(_SITE + "n_alt = 2")
def min_max_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    vs = derived(spark, sf_dir)
    for text in X.allele_option(3, 3):
        vs = vs.with_filter(text)
    return _ids(vs)


@query("SELECT k AS variant_index FROM t GROUP BY k HAVING bool_or(kind = 'snp')")
def types_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_filter(X.type_option("snps", None)))


# --- scans, regions, selections ---------------------------------------------------------
@query("SELECT k AS variant_index, pos, dp AS info_DP FROM v")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(derived(spark, sf_dir), ["POS", "INFO/DP"])


@query(_SITE + "chrom = 'c1' AND pos <= 6000 AND pos + rlen - 1 >= 5000")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_regions("c1:5000-6000"))


@query(_SITE + "(chrom = 'c0' AND pos <= 2000 AND pos + rlen - 1 >= 1003) OR (chrom = 'c2' AND pos <= 77 AND pos + rlen - 1 >= 77) OR chrom = 'c4'")
def region_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_regions(["c0:1003-2000", "c2:77", "c4"]))


@query(_SITE + "chrom = 'c3' AND pos + rlen - 1 >= 20000")
def region_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_regions(["c3:20000-"]))


@query("SELECT DISTINCT k AS variant_index FROM v, range(0, 200) r(x) WHERE chrom = 'c' || (x % 5) AND pos <= 100 * x + 15 AND pos + rlen - 1 >= 100 * x")
def region_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list long enough for a broadcast join."""
    return _ids(derived(spark, sf_dir).with_regions([(f"c{x % 5}", 100 * x, 100 * x + 15) for x in range(200)]))


@query(_SITE + "chrom = 'c1' AND pos BETWEEN 5000 AND 6000")
def target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_targets("c1:5000-6000"))


@query(_SITE + "NOT (chrom = 'c1' AND pos BETWEEN 5000 AND 6000) AND chrom <> 'c0'")
def target_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_targets(["c1:5000-6000", "c0"], complement=True))


@query(_SITE + "chrom = 'c1' AND pos <= 6000 AND pos + rlen - 1 >= 5000 AND NOT pos BETWEEN 5200 AND 5400")
def region_and_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_regions("c1:5000-6000").with_targets("c1:5200-5400", complement=True))


@query("SELECT k AS variant_index, pos FROM v WHERE k IN (3, 17, 1000, 14999)")
def variant_index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).with_variants([1000, 3, 17, 14999, 3]).df.select("variant_index", "pos")


@query(_SITE + "k >= 14000")
def start_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).starting_at(14000))


@query(_SITE + "dp > 95 AND chrom = 'c2'")
def filter_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(derived(spark, sf_dir).with_regions("c2").with_filter("INFO/DP > 95").materialised())


def _calls(vs: VariantSet) -> DataFrame:
    """One row a selected sample."""
    each = F.arrays_zip(names(vs.sample_ids).alias("sample"), vs.call("fmt_DP").alias("dp"), vs.call("fmt_GQ").alias("gq"))
    return vs.df.select("variant_index", F.posexplode(each).alias("place", "x")).select("variant_index", F.col("place").cast("long").alias("place"), "x.sample", F.col("x.dp").cast("long").alias("dp"), F.col("x.gq").cast("long").alias("gq"))


_CALLS = "SELECT k AS variant_index, CAST(place AS BIGINT) AS place, sample, cdp AS dp, gq FROM c JOIN name ON name.i = c.i JOIN pick ON pick.i = c.i"


def _pick(*places: int) -> str:
    return "pick AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p})" for p, i in enumerate(places)) + ") x(i, place))"


@query(_CALLS, _pick(5, 2, 9))
def sample_subset_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(derived(spark, sf_dir).with_samples(["S05", "S02", "S09"]))


@query(_CALLS, _pick(0, 2, 3, 5, 6, 7, 8, 10, 11))
def sample_complement_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(derived(spark, sf_dir).with_samples(["S09", "S01", "S04", "S09"], complement=True))


@query(_CALLS, _pick(11, 0, 0))
def sample_index_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(derived(spark, sf_dir).with_sample_indexes([11, 0, 0]))


# --- derived fields -----------------------------------------------------------------------
@query("SELECT an.k AS variant_index, an, ns, n_alt, 12 - ns AS n_missing, (12 - ns) / 12.0::DOUBLE AS f_missing FROM an JOIN v ON v.k = an.k")
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vs = derived(spark, sf_dir)
    cols = [D.compute(n, F.col("gt"), F.col("alts")) for n in ("AN", "NS", "N_ALT", "N_MISSING")]
    return vs.df.select("variant_index", *[c.cast("long").alias(n) for c, n in zip(cols, ("an", "ns", "n_alt", "n_missing"), strict=True)], D.f_missing(F.col("gt")).alias("f_missing"))


@query("SELECT k AS variant_index, j AS allele, n AS ac FROM ac")
def allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(D.allele_counts(F.col("gt"), F.col("alts"))).alias("j", "n")
    return derived(spark, sf_dir).df.select("variant_index", each).select("variant_index", (F.col("j") + 1).cast("long").alias("allele"), F.col("n").cast("long").alias("ac"))


@query("SELECT ac.k AS variant_index, j AS allele, CASE WHEN an > 0 THEN CAST(CAST(n AS FLOAT) / CAST(an AS FLOAT) AS DOUBLE) END AS af FROM ac JOIN an ON an.k = ac.k")
def allele_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(D.allele_frequencies(F.col("gt"), F.col("alts"))).alias("j", "f")
    return derived(spark, sf_dir).df.select("variant_index", each).select("variant_index", (F.col("j") + 1).cast("long").alias("allele"), F.col("f").cast("double").alias("af"))


@query(
    "SELECT k AS variant_index, 'native' AS mode, sub AS an FROM two WHERE sub > 3 UNION ALL SELECT k, 'bcftools', stored FROM two WHERE stored > 21 UNION ALL SELECT k, 'forced', sub FROM two WHERE stored > 22",
    "two AS (SELECT v.k, count(al) AS sub, 24 - v.k % 5 AS stored FROM v JOIN g ON g.k = v.k WHERE i IN (3, 1) GROUP BY v.k)",
)
def subset_native_vs_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which AN a filter and the output see: computed on the subset, stored, or forced on output only."""
    vs = derived(spark, sf_dir, stored_an=True).with_samples(["S03", "S01"])
    cases = {"native": vs.with_filter("INFO/AN > 3"), "bcftools": vs.with_mode("bcftools").with_filter("INFO/AN > 21"), "forced": vs.with_mode("bcftools", forced=["AN"]).with_filter("INFO/AN > 22")}
    parts = [result(s).df.select("variant_index", F.lit(mode).alias("mode"), info(s, "AN")[0].cast("long").alias("an")) for mode, s in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT k AS variant_index, count(CASE WHEN i IN (0, 1) AND cdp > 38 THEN 1 END) AS n_cells FROM c GROUP BY k HAVING bool_or(cdp > 38)")
def view_full_cohort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``view``: samples outside the subset decide too, and the cells are those of the subset."""
    out = result(derived(spark, sf_dir).with_samples(["S00", "S01"]).with_mode("bcftools", view=True).with_filter("FMT/DP > 38"))
    return out.df.select("variant_index", F.size(F.filter(out.cells, lambda x: x)).cast("long").alias("n_cells"))


# --- formats ------------------------------------------------------------------------------
_ALTS = "(SELECT string_agg(alt, ',' ORDER BY j) FROM a WHERE a.k = v.k)"
_FILTERS = "CASE WHEN len(filters) = 0 THEN '.' ELSE array_to_string(filters, ';') END"
_DOT = "coalesce(CAST({} AS VARCHAR), '.')".format


@query(f"SELECT k AS variant_index, chrom || chr(9) || pos || chr(9) || {_DOT('id')} || ' ' || ref || '>' || {_ALTS} || chr(9) || {_FILTERS} || ' ' || {_DOT('dp')} || ' ' || CASE WHEN db THEN 'True' ELSE '.' END || chr(10) AS text FROM v")
def query_site_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(derived(spark, sf_dir), r"%CHROM\t%POS\t%ID %REF>%ALT\t%FILTER %INFO/DP %DB\n")


@query("SELECT v.k AS variant_index, pos || ':' || string_agg(sample || '=' || coalesce(CAST(cdp AS VARCHAR), '.') || ',' || pos || ' ', '' ORDER BY c.i) || chr(10) AS text FROM v JOIN c ON c.k = v.k JOIN name ON name.i = c.i GROUP BY v.k, pos")
def query_sample_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(derived(spark, sf_dir), "%POS:[%SAMPLE=%DP,%POS ]")


@query("SELECT k AS variant_index, string_agg(sample || ':' || cdp || ' ', '' ORDER BY c.i) || chr(10) AS text FROM c JOIN name ON name.i = c.i WHERE cdp > 35 GROUP BY k")
def query_sample_loop_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(derived(spark, sf_dir).with_filter("FMT/DP > 35"), "[%SAMPLE:%DP ]")


@query("SELECT v.k AS variant_index, coalesce((SELECT CAST(xa AS VARCHAR) FROM a WHERE a.k = v.k AND j = 2), '.') || '/' || (k % 5) || '/' || CASE WHEN (SELECT count(xa) FROM a WHERE a.k = v.k) = 0 THEN '.' ELSE (SELECT string_agg(coalesce(CAST(xa AS VARCHAR), '.'), ',' ORDER BY j) FROM a WHERE a.k = v.k) END || chr(10) AS text FROM v")
def query_subfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(derived(spark, sf_dir), "%XA{1}/%XP{0}/%XA")


@query("SELECT k AS variant_index, string_agg(gt, ' ' ORDER BY i) || ' ' || chr(10) AS text FROM gt GROUP BY k")
def query_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(derived(spark, sf_dir), "[%GT ]")


@query("SELECT k AS variant_index, CASE WHEN qual IS NULL THEN '.' ELSE printf('%g', qual) END || chr(10) AS text FROM v")
def query_qual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(derived(spark, sf_dir), "%QUAL")


# --- sinks ----------------------------------------------------------------------------------
_INFO = """coalesce(nullif(concat_ws(';', CASE WHEN db THEN 'DB' END, 'DP=' || dp, 'XA=' || (SELECT string_agg(coalesce(CAST(xa AS VARCHAR), '.'), ',' ORDER BY j) FROM a WHERE a.k = v.k HAVING count(xa) > 0), 'XP=' || (v.k % 5) || ',' || ((v.k + 3) % 7)), ''), '.')"""
_QUAL = "coalesce(regexp_replace(regexp_replace(printf('%.3f', qual), '0+$', ''), '\\.$', ''), '.')"


@query(
    f"SELECT v.k AS variant_index, chrom || chr(9) || pos || chr(9) || {_DOT('id')} || chr(9) || ref || chr(9) || {_ALTS} || chr(9) || {_QUAL} || chr(9) || {_FILTERS} || chr(9) || {_INFO} || chr(9) || 'GT:DP:GQ' || chr(9) || "
    f"(SELECT string_agg(gt.gt || ':' || {_DOT('cdp')} || ':' || {_DOT('gq')}, chr(9) ORDER BY c.i) FROM c JOIN gt ON gt.k = c.k AND gt.i = c.i WHERE c.k = v.k) AS line FROM v"
)
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.lines(derived(spark, sf_dir))


@query(
    "SELECT v.k AS variant_index, 'AC=' || (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY j) FROM sub WHERE sub.k = v.k) || ';AN=' || (SELECT count(al) FROM g WHERE g.k = v.k AND i IN (2, 7, 11)) AS text FROM v",
    "sub AS (SELECT a.k, a.j, count(g.al) AS n FROM a LEFT JOIN g ON g.k = a.k AND g.al = a.j AND g.i IN (2, 7, 11) GROUP BY a.k, a.j)",
)
def vcf_fill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AC and AN of a subset, as ``view -s`` writes them."""
    vs = derived(spark, sf_dir).with_samples(["S07", "S02", "S11"]).with_mode("bcftools", view=True, forced=["AC", "AN"])
    pairs = [info(vs, "AC"), info(vs, "AN")]
    return vs.df.select("variant_index", vcf.info_text(vs, pairs).alias("text"))


@query("SELECT CAST(substr(chrom, 2) AS BIGINT) AS contig_index, chrom AS contig, '.' AS length, count(*) AS records FROM v GROUP BY chrom")
def contig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contig_counts(derived(spark, sf_dir)).withColumn("contig_index", F.col("contig_index").cast("long"))


@query("SELECT count(*) AS records FROM v")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).df.agg(F.count("*").alias("records"))


def _biallelic(spark: SparkSession, sf_dir: str) -> VariantSet:
    return derived(spark, sf_dir).with_filter(X.allele_option(None, 2)[0]).materialised()


@query(f"SELECT v.k AS variant_index, chrom, {_DOT('id')} AS id, 0 AS cm, pos, alt AS a1, v.ref AS a2 FROM v JOIN a ON a.k = v.k WHERE v.n_alt = 1")
def bim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plink.bim(_biallelic(spark, sf_dir))


_CODES = "code AS (SELECT g.k, i, CASE WHEN count(al) < count(*) THEN 1 WHEN min(al) = 0 AND max(al) = 0 THEN 3 WHEN min(al) = 1 THEN 0 ELSE 2 END AS code FROM g JOIN v ON v.k = g.k WHERE n_alt = 1 GROUP BY g.k, i)"


@query("SELECT k AS variant_index, string_agg(printf('%02x', byte), '' ORDER BY b) AS bed FROM (SELECT k, i // 4 AS b, CAST(sum(code << CAST(2 * (i % 4) AS INT)) AS BIGINT) AS byte FROM code GROUP BY k, i // 4) GROUP BY k", _CODES)
def bed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plink.bed(_biallelic(spark, sf_dir)).select("variant_index", F.lower(F.hex("bed")).alias("bed"))


_BYTES = """call AS (SELECT g.k, g.i, count(*) AS ploidy, count(al) < count(*) AS missing, max(CASE WHEN p = 0 THEN al END) AS x, max(CASE WHEN p = 1 THEN al END) AS y FROM g JOIN v ON v.k = g.k WHERE n_alt = 1 GROUP BY g.k, g.i),
flag AS (SELECT k, bool_and(phased) AS phased FROM c GROUP BY k),
piece AS (SELECT call.k, i, CASE WHEN missing THEN printf('%02x', 128 + ploidy) ELSE printf('%02x', ploidy) END AS head, CASE WHEN missing THEN repeat('00', CAST(ploidy AS INT)) WHEN ploidy = 1 THEN CASE WHEN x = 0 THEN 'ff' ELSE '00' END
    WHEN phased THEN CASE WHEN x = 0 THEN 'ff' ELSE '00' END || CASE WHEN y = 0 THEN 'ff' ELSE '00' END ELSE CASE WHEN x + y = 0 THEN 'ff' ELSE '00' END || CASE WHEN x + y = 1 THEN 'ff' ELSE '00' END END AS share, ploidy, phased FROM call JOIN flag ON flag.k = call.k)"""


@query("SELECT k AS variant_index, '0c0000000200' || printf('%02x', min(ploidy)) || printf('%02x', max(ploidy)) || string_agg(head, '' ORDER BY i) || CASE WHEN bool_and(phased) THEN '01' ELSE '00' END || '08' || string_agg(share, '' ORDER BY i) AS genotypes FROM piece GROUP BY k", _BYTES)
def bgen_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncompressed genotype block of each variant, cut out of a stored one."""
    made = bgen.blocks(_biallelic(spark, sf_dir), bgen.Layout(level=0))
    body = F.hex("block")
    strings = 6 + F.length("rsid") + 1 + F.length("chrom") + 4 + 2 + 8 + F.length("ref") + F.length("alt") + 8
    size = F.octet_length("block") - strings - 11
    return made.select("variant_index", F.lower(F.substring(body, 2 * (strings + 7) + 1, 2 * size)).alias("genotypes"))


@query(
    "SELECT k AS variant_index, pos, rsid, CAST(92 + coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(size AS BIGINT) AS size FROM sized",
    "sized AS (SELECT v.k, v.pos, coalesce(v.id, '.') AS rsid, 6 + 1 + length(coalesce(v.id, '.')) + length(chrom) + 4 + 2 + 8 + length(v.ref) + length(alt) + 8 + 11 + 10 + 12 + (SELECT count(*) FROM g WHERE g.k = v.k) AS size FROM v JOIN a ON a.k = v.k WHERE v.n_alt = 1)",
)
def bgen_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bgen.index_rows(_biallelic(spark, sf_dir), bgen.Layout(level=0))
    return rows.select("variant_index", "pos", "rsid", "start", "size")


# --- whole files, sidecars and errors ---------------------------------------------------------
def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(
    "SELECT CAST(row_number() OVER (ORDER BY a, b) AS INT) AS place, line FROM lines",
    """lines AS (SELECT 0 AS a, 0 AS b, '##fileformat=VCFv4.3' AS line UNION ALL SELECT 1, 0, '##source=orders' UNION ALL SELECT 2, 1, '##INFO=<ID=DB,Number=0,Type=Flag,Description="dbSNP membership">' UNION ALL SELECT 2, 2, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total depth">'
    UNION ALL SELECT 2, 3, '##INFO=<ID=XA,Number=A,Type=Integer,Description="">' UNION ALL SELECT 2, 4, '##INFO=<ID=XP,Number=2,Type=Integer,Description="">' UNION ALL SELECT 3, x, '##FILTER=<ID=' || ['PASS', 'q10', 's50'][x] || ',Description="">' FROM range(1, 4) r(x)
    UNION ALL SELECT 4, 0, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">' UNION ALL SELECT 4, 1, '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">' UNION ALL SELECT 4, 2, '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Conditional genotype quality">'
    UNION ALL SELECT 5, x, '##contig=<ID=c' || x || '>' FROM (SELECT unnest(range(0, greatest(8, max(o_orderkey) // 3000 + 1))) AS x FROM orders)
    UNION ALL SELECT 6, 0, '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9) || (SELECT string_agg(sample, chr(9) ORDER BY i) FROM name))""",
)
def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of the output, line by line."""
    text = vcf.header(derived(spark, sf_dir), (), False)
    return _rows(spark, [(k + 1, line) for k, line in enumerate(text.splitlines())], "place int, line string")


@query(
    "SELECT k AS variant_index, coalesce(nullif(concat_ws(':', CASE WHEN gt SIMILAR TO '.*[0-9].*' THEN 'GT' END, CASE WHEN cdp IS NOT NULL THEN 'DP' END, CASE WHEN gq IS NOT NULL THEN 'GQ' END), ''), '.') || chr(9) || coalesce(nullif(concat_ws(':', CASE WHEN gt SIMILAR TO '.*[0-9].*' THEN gt END, CAST(cdp AS VARCHAR), CAST(gq AS VARCHAR)), ''), '.') AS call FROM one",
    "one AS (SELECT gt.k, gt.gt, cdp, gq FROM gt JOIN c ON c.k = gt.k AND c.i = gt.i WHERE gt.i = 5)",
)
def vcf_missing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FORMAT and call of one sample: keys that no call has are left out, and a row without any is dots."""
    line = vcf.lines(derived(spark, sf_dir).with_samples(["S05"]))
    return line.select("variant_index", F.concat_ws("\t", F.get(F.split("line", "\t"), F.lit(8)), F.get(F.split("line", "\t"), F.lit(9))).alias("call"))


@query(f"SELECT v.k AS variant_index, chrom || chr(9) || pos || chr(9) || {_DOT('id')} || chr(9) || ref || chr(9) || {_ALTS} || chr(9) || {_QUAL} || chr(9) || {_FILTERS} || chr(9) || {_INFO} AS line FROM v")
def vcf_without_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty selection of samples writes sites only."""
    return vcf.lines(derived(spark, sf_dir).with_samples([]))


@query(_ANY + "qual > 100000 AND cdp > 30 AND (v.n_alt < 3 OR EXISTS (SELECT 1 FROM a WHERE a.k = v.k AND NOT coalesce(xa > 9, false)))")
def filters_of_all_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of sites, one of samples and an exclusion by alleles, one after the other."""
    vs = derived(spark, sf_dir).with_filter("QUAL > 100000").with_filter("FMT/DP > 30").with_filter(exclude="INFO/XA > 9")
    return _ids(vs)


_LABELS = {"chr1": "1", "chrM": "MT", "chrX": "X", "chrUn": "chrUn", "22": "22", "chr22": "22", "chr23": "chr23"}


@query(f"SELECT k AS variant_index, CASE k % 7 {' '.join(f"WHEN {n} THEN '{to}'" for n, to in enumerate(_LABELS.values()))} END AS chrom FROM v WHERE n_alt = 1")
def bim_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of human contigs as PLINK has them, and others as they are."""
    vs = _biallelic(spark, sf_dir)
    named = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("variant_index") % 7 + 1).cast("int"))
    return plink.bim(vs.with_frame(vs.df.withColumn("chrom", named))).select("variant_index", "chrom")


@query("SELECT CAST(i AS INT) AS place, sample || chr(9) || sample || chr(9) || '0' || chr(9) || '0' || chr(9) || '0' || chr(9) || '-9' AS fam, sample || ' ' || sample || ' 0' AS sample FROM name")
def sample_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``.fam`` and of ``.sample`` (behind its two head lines)."""
    names = derived(spark, sf_dir).sample_ids
    pairs = zip(plink.fam(names).splitlines(), bgen.sample_text(names).splitlines()[2:], strict=True)
    return _rows(spark, [(k, *pair) for k, pair in enumerate(pairs)], "place int, fam string, sample string")


_FOUR = "printf('%02x%02x%02x%02x', CAST({0} % 256 AS INT), CAST({0} // 256 % 256 AS INT), CAST({0} // 65536 % 256 AS INT), CAST({0} // 16777216 AS INT))".format


@query(f"SELECT {_FOUR('88')} || {_FOUR('20')} || {_FOUR('n')} || {_FOUR('12')} || '6267656e' || {_FOUR('2147483657')} || {_FOUR('68')} || {_FOUR('12')} || (SELECT string_agg('0300' || lower(hex(encode(sample))), '' ORDER BY i) FROM name) AS header FROM (SELECT count(*) AS n FROM v WHERE n_alt = 1)")
def bgen_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    vs = _biallelic(spark, sf_dir)
    return _rows(spark, [(bgen.header(vs.num_variants(), vs.sample_ids).hex(),)], "header string")


@query("SELECT v.k AS variant_index, CAST(6 + 6 + 8 + 64 + 8 + (6 + 5 + 8 + 2 + 3 * 2) AS BIGINT) AS size, coalesce(v.id, '.') AS rsid FROM v WHERE n_alt = 1 AND k % 17 NOT IN (0, 16)")
def bgen_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose strings fill a budget of 64 bytes all have one size."""
    vs = _biallelic(spark, sf_dir)
    vs = vs.with_frame(vs.df.where("variant_index % 17 not in (0, 16)")).with_samples(["S00", "S01"])
    return bgen.blocks(vs, bgen.Layout(level=0, budget=64)).select("variant_index", F.octet_length("block").cast("long").alias("size"), "rsid")


@query(
    "SELECT off, lower(substr(bed, CAST(2 * off + 1 AS INT), CAST(2 * size AS INT))) AS bytes FROM whole, (VALUES (CAST(0 AS BIGINT), 5), (2, 1), (1000, 300), (3001, 7)) r(off, size)",
    _CODES + ", whole AS (SELECT '6c1b01' || string_agg(bed, '' ORDER BY k) AS bed FROM (SELECT k, string_agg(printf('%02x', byte), '' ORDER BY b) AS bed FROM (SELECT k, i // 4 AS b, CAST(sum(code << CAST(2 * (i % 4) AS INT)) AS BIGINT) AS byte FROM code GROUP BY k, i // 4) GROUP BY k))",
)
def bed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a ``.bed`` file that was never written."""
    encoder = BedEncoder(_biallelic(spark, sf_dir), block_bytes=900)
    return _rows(spark, [(off, encoder.read(off, size).hex()) for off, size in ((0, 5), (2, 1), (1000, 300), (3001, 7))], "off long, bytes string")


#: What callers do wrong, and the error that tells them.
_WRONG = {
    "DP > 3": "ValueError", "INFO/NOPE > 3": "ValueError", "MAF > 0.1": "UnsupportedCalculatedVariableError", "XA[0] > 1": "UnsupportedArraySubscriptError", "ID ~ 7": "UnsupportedRegexError", "MAX(FMT/DP) > 9": "UnsupportedFunctionsError", 'TYPE = "mnp"': "UnsupportedTypeFieldError",
    'GT = "het"': "UnsupportedGenotypeValuesError", 'INFO/DP = "."': "UnsupportedMissingDataError", "ID = @names": "UnsupportedFileReferenceError", "POS >": "FilterSyntaxError", 'FILTER = "nope"': "ValueError", "INFO/XA > INFO/XP": "ValueError",
}


@query("SELECT expression, error FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in _WRONG.items()) + ", ('region nowhere', 'ValueError'), ('sample nobody', 'ValueError'), ('samples twice', 'RuntimeError'), ('variants of several ALTs', 'NotImplementedError')) e(expression, error)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, regions, samples and outputs that are refused, and how."""
    vs = derived(spark, sf_dir)
    tries = {text: (lambda text=text: result(vs.with_filter(text))) for text in _WRONG} | {
        "region nowhere": lambda: vs.with_regions("nowhere:5"), "sample nobody": lambda: vs.with_samples(["nobody"]), "samples twice": lambda: vs.with_samples(["S01"]).with_samples(["S02"]), "variants of several ALTs": lambda: plink.write_plink(vs.with_filter("N_ALT > 1"), "nowhere"),
    }
    rows = []
    for name, call in tries.items():
        try:
            call()
            rows.append((name, "none"))
        except Exception as e:  # noqa: BLE001  its kind is the result
            rows.append((name, type(e).__name__))
    return _rows(spark, rows, "expression string, error string")


@query(f"SELECT v.k AS variant_index, chrom, pos, ref || '>' || {_ALTS} AS change, CAST(an AS BIGINT) AS an FROM v JOIN an ON an.k = v.k")
def parquet_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set written as Parquet with its calls in blocks of five samples, and read back."""
    path = f"{scratch(spark)}/set"
    tables.write(derived(spark, sf_dir), path, block=5)
    vs = tables.read(spark, path)
    return result(vs).df.select("variant_index", "chrom", "pos", F.concat("ref", F.lit(">"), F.array_join("alts", ",")).alias("change"), D.allele_number(vs.call("gt")).cast("long").alias("an"))


@query(f"SELECT v.k AS variant_index, chrom, pos, ref || '>' || {_ALTS} AS change, CAST(dp AS BIGINT) AS dp FROM v WHERE v.k <= 2000")
def vcf_text_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 keys written as VCF text in parts, and read back: numbered by their place."""
    path = f"{scratch(spark)}/text"
    vs = derived(spark, sf_dir)
    few = vs.with_frame(vs.df.where("variant_index <= 2000"))
    vcf.write_parts(few, path)
    spark.read.text(f"{path}/header").unionByName(spark.read.text(f"{path}/records")).coalesce(1).write.text(f"{path}/one.vcf")
    back = vcf_source.read(spark, f"{path}/one.vcf")
    return back.df.select("variant_index", "chrom", "pos", F.concat("ref", F.lit(">"), F.array_join("alts", ",")).alias("change"), F.col("info_DP").cast("long").alias("dp"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts of the variants of a region that pass a filter over samples."""
    vs = derived(spark, sf_dir).with_regions("c0:1000-9000").with_filter("QUAL > 50000 && FMT/DP > 30")
    return result(vs).df.select("variant_index", "chrom", "pos", F.array_join(D.allele_counts(F.col("gt"), F.col("alts")), ",").alias("ac"), D.allele_number(F.col("gt")).cast("long").alias("an"))


QUERIES["flagship"] = (
    flagship,
    MODEL_ONLY + " SELECT v.k AS variant_index, chrom, pos, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY j) FROM ac WHERE ac.k = v.k) AS ac, an FROM v JOIN an ON an.k = v.k WHERE chrom = 'c0' AND pos <= 9000 AND pos + rlen - 1 >= 1000 AND qual > 50000 AND v.k IN (SELECT k FROM c WHERE cdp > 30)",
)


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
