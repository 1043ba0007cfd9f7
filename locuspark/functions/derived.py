"""Fields computed from genotypes and alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locuspark.functions.binding import let, lets

#: Name: (number, type, needs genotypes, description).
VIRTUAL = {
    "AC": ("A", "Integer", True, "Allele count in genotypes"),
    "AN": ("1", "Integer", True, "Total number of alleles in called genotypes"),
    "AF": ("A", "Float", True, "Allele frequency for each ALT allele in the same order as listed"),
    "NS": ("1", "Integer", True, "Number of samples with data"),
    "N_ALT": ("1", "Integer", False, "Number of ALT alleles"),
    "N_MISSING": ("1", "Integer", True, "Number of samples without a called allele"),
    "F_MISSING": ("1", "Float", True, "Share of samples without a called allele"),
}


def called(gt: Column) -> Column:
    return F.filter(F.flatten(gt), lambda a: a.isNotNull())


def allele_number(gt: Column) -> Column:
    return F.size(called(gt))


def n_alt(alts: Column) -> Column:
    return F.size(alts)


def allele_counts(gt: Column, alts: Column) -> Column:
    """One count for each ALT; an allele beyond them is an error."""

    def counted(slots: Column, own: Column) -> Column:
        bad = (F.array_max(slots) > F.size(own)) | (F.array_min(slots) < 0)
        counts = F.transform(own, lambda _, k: F.size(slots) - F.size(F.array_remove(slots, k + 1)))
        return F.when(bad, F.raise_error(F.lit("a genotype names an allele that the variant does not have"))).otherwise(counts)

    return lets((called(gt).cast("array<int>"), alts), counted)


def allele_frequencies(gt: Column, alts: Column) -> Column:
    def shares(own: Column) -> Column:
        return let(allele_number(own).cast("float"), lambda an: F.transform(allele_counts(own, alts), lambda c: F.when(an > 0, (c.cast("float") / an).cast("float"))))

    return let(gt, shares)


def samples_with_data(gt: Column) -> Column:
    return F.size(F.filter(gt, lambda g: F.exists(g, lambda a: a.isNotNull())))


def n_missing(gt: Column) -> Column:
    return let(gt, lambda own: (F.size(own) - samples_with_data(own)).cast("long"))


def f_missing(gt: Column) -> Column:
    return let(gt, lambda own: F.when(F.size(own) > 0, n_missing(own).cast("double") / F.size(own)).otherwise(F.lit(0.0)))


def compute(name: str, gt: Column | None, alts: Column) -> Column:
    return {
        "AC": lambda: allele_counts(gt, alts), "AN": lambda: allele_number(gt), "AF": lambda: allele_frequencies(gt, alts), "NS": lambda: samples_with_data(gt),
        "N_ALT": lambda: n_alt(alts).cast("long"), "N_MISSING": lambda: n_missing(gt), "F_MISSING": lambda: f_missing(gt),
    }[name]()


def alt_type(ref: Column, alt: Column) -> Column:
    """``ref``, ``snp`` or ``other`` of one ALT."""
    n = F.length(ref)
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(ref, i, F.lit(1)) != F.substr(alt, i, F.lit(1))))
    return (
        F.when(alt.isin("", "<*>", "<NON_REF>"), "ref")
        .when((n == 1) & (F.length(alt) == 1), F.when(alt == ref, "ref").when(alt == "*", "other").otherwise("snp"))
        .when((n == F.length(alt)) & (n > 1) & (wrong == 1), "snp")
        .otherwise("other")
    )


def type_mask(ref: Column, alts: Column, kind: str, some: bool) -> Column:
    """Whether all ALTs (or, with ``some``, any) are of ``kind``."""
    kinds = F.transform(alts, lambda a: alt_type(ref, a))
    if kind == "ref":
        return F.forall(kinds, lambda k: k == "ref")
    if some:
        return F.exists(kinds, lambda k: k == "snp")
    return let(kinds, lambda own: F.exists(own, lambda k: k == "snp") & F.forall(own, lambda k: k.isin("snp", "ref")))
