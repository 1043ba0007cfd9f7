"""VCF text: a header from metadata, and one line a variant."""

from __future__ import annotations

import datetime
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuspark.functions.binding import let
from locuspark.functions.text import three_decimals, vcf_text
from locuspark.model import Field, VariantSet
from locuspark.plans.formats import genotype_text
from locuspark.plans.resolve import info, result
from locuspark.sinks.ordered import in_order, opened

#: Descriptions of reserved keys, for fields that have none.
INFO_TEXT = {"AA": "Ancestral allele", "AC": "Allele count in genotypes", "AF": "Allele frequency for each ALT allele in the same order as listed", "AN": "Total number of alleles in called genotypes", "DB": "dbSNP membership", "DP": "Combined depth across samples", "END": "End position on CHROM", "H2": "HapMap2 membership", "MQ": "RMS mapping quality", "NS": "Number of samples with data"}
FORMAT_TEXT = {"AD": "Read depth for each allele", "DP": "Read depth", "GQ": "Conditional genotype quality", "HQ": "Haplotype quality", "PL": "Phred-scaled genotype likelihoods rounded to the closest integer", "PS": "Phase set"}
FILL_TAGS = ("AC", "AF", "AN", "NS")
_LATER = ("MAF", "AC_Hom", "AC_Het", "AC_Hemi")


def fill_tags(text: str) -> tuple[str, ...]:
    """The names of a ``--fill-tags`` list, checked."""
    names = tuple(t for t in text.split(",") if t)
    for t in names:
        if t in _LATER:
            raise ValueError(f"the tag {t} is not yet implemented")
        if t not in FILL_TAGS:
            raise ValueError(f"the tag {t!r} cannot be filled")
    return names


def info_fields(vs: VariantSet, extra: Sequence[str] = ()) -> list[tuple[Column, Field]]:
    """Columns and descriptions of the INFO keys that a record has, by name."""
    keys = sorted({f.key for f in vs.fields if f.category == "INFO"} | set(extra))
    return [pair for k in keys if (pair := info(vs, k)) is not None]


def header(vs: VariantSet, extra: Sequence[str] = (), version: bool = True, command: Sequence[str] | None = None) -> str:
    out = ["##fileformat=VCFv4.3"]
    if vs.source is not None:
        out.append(f"##source={vs.source}")
    for _, f in info_fields(vs, extra):
        out.append(f'##INFO=<ID={f.key},Number={f.number},Type={f.type},Description="{f.description if f.description is not None else INFO_TEXT.get(f.key, "")}">')
    for k, name in enumerate(vs.filters):
        out.append(f'##FILTER=<ID={name},Description="{vs.filter_descriptions[k] if vs.filter_descriptions else ""}">')
    if vs.sample_ids:
        if vs.has_genotypes:
            out.append('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
        for f in sorted((f for f in vs.fields if f.category == "FORMAT"), key=lambda f: f.key):
            out.append(f'##FORMAT=<ID={f.key},Number={f.number},Type={f.type},Description="{f.description if f.description is not None else FORMAT_TEXT.get(f.key, "")}">')
    for k, name in enumerate(vs.contigs):
        out.append(f"##contig=<ID={name},length={vs.contig_lengths[k]}>" if vs.contig_lengths else f"##contig=<ID={name}>")
    if version:
        out.append(f"##locuspark_viewCommand={' '.join(sys.argv[1:] if command is None else command)}; Date={datetime.datetime.now()}")
    out += [f"##{k}={v}" for k, v in vs.meta if k not in ("fileformat", "source")]
    out.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *vs.sample_ids] if vs.sample_ids else [])]))
    return "\n".join(out) + "\n"


def _type(vs: VariantSet, field: Field) -> T.DataType:
    """The type of one value: that of the stored column, or of the computed one."""
    if field.column in vs.df.columns or vs.has(field.column):
        kind = vs.kind(field.column)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
    else:
        kind = {"Integer": T.IntegerType(), "Float": T.FloatType(), "Flag": T.BooleanType()}.get(field.type, T.StringType())
    return T.ArrayType(kind) if field.vector else kind


def info_text(vs: VariantSet, pairs: list[tuple[Column, Field]]) -> Column:
    """The INFO column: missing fields are left out, a flag prints its key only."""
    parts = []
    for col, f in pairs:
        if f.number == "0":
            parts.append(F.when(col, f.key))
        elif f.vector:
            parts.append(F.when(F.exists(col, lambda x: x.isNotNull()), F.concat(F.lit(f.key + "="), vcf_text(col, _type(vs, f), f.key))))
        else:
            parts.append(F.concat(F.lit(f.key + "="), vcf_text(col, _type(vs, f), f.key)))
    if not parts:
        return F.lit(".")
    joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ";")
    return F.when(joined == "", ".").otherwise(joined)


def format_text(vs: VariantSet) -> list[Column]:
    """The FORMAT column and the samples' text: a field that every sample lacks is left out of the row."""
    made: list[tuple[str, Column, Column]] = []
    if vs.has_genotypes:
        gt = vs.call("gt")
        pair = F.zip_with(gt, vs.call("phased"), genotype_text) if vs.has("phased") else F.transform(gt, lambda g: genotype_text(g, F.lit(False)))
        made.append(("GT", F.exists(gt, lambda g: F.exists(g, lambda a: a.isNotNull())), pair))
    made += [_format_field(vs, f) for f in sorted((f for f in vs.fields if f.category == "FORMAT"), key=lambda f: f.key)]
    if not made:
        return [F.lit("."), F.lit("\t".join(["."] * len(vs.sample_ids)))]
    zipped = F.arrays_zip(*[text.alias(f"p{k}") for k, (_, _, text) in enumerate(made)])
    given = lambda parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ":")

    def cells(there: Column) -> Column:
        flags = [F.get(there, F.lit(k)) for k in range(len(made))]
        one = lambda z: given([F.when(flag, z[f"p{k}"]) for k, flag in enumerate(flags)])
        some = F.exists(there, lambda x: x)
        keys = F.when(some, given([F.when(flag, key) for flag, (key, _, _) in zip(flags, made, strict=True)])).otherwise(".")
        return F.array(keys, F.array_join(F.transform(zipped, lambda z: F.when(some, one(z)).otherwise(".")), "\t"))

    both = let(F.array(*[there for _, there, _ in made]), cells)
    return [F.array_join(both, "\t")]


def _format_field(vs: VariantSet, f: Field) -> tuple[str, Column, Column]:
    """Key, whether any sample has it, and its text by sample."""
    col, kind = vs.call(f.column), _type(vs, f)
    if not f.vector:
        return f.key, F.exists(col, lambda x: x.isNotNull()), F.transform(col, lambda x: F.coalesce(vcf_text(x, kind, f.key), F.lit(".")))
    there = F.exists(col, lambda v: F.exists(v, lambda x: x.isNotNull()))
    return f.key, there, F.transform(col, lambda v: F.when(v.isNull() | (F.size(v) == 0), ".").otherwise(vcf_text(v, kind, f.key)))


def lines(vs: VariantSet, extra: Sequence[str] = ()) -> DataFrame:
    """``variant_index, line`` of the rows that pass, without newlines."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    vs = vs.reading(None)
    out = result(vs).df
    filters = F.when(F.size("filters") == 0, ".").otherwise(F.array_join("filters", ";"))
    alts = F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ","))
    cols = [F.col("chrom"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), alts, dot(three_decimals(F.col("qual"))), filters, info_text(vs, info_fields(vs, extra))]
    cols += format_text(vs) if vs.sample_ids else []
    return out.select("variant_index", F.concat_ws("\t", *cols).alias("line"))


def write(vs: VariantSet, output, header_only: bool = False, no_header: bool = False, no_version: bool = False, fill: Sequence[str] = ()) -> None:
    """VCF text to a path or a text file; compressed formats are refused."""
    if isinstance(output, str) and output.rpartition(".")[2] in ("gz", "bgz", "bcf"):
        raise ValueError("only plain text output is supported")
    vs = vs.with_mode(vs.mode, vs.view, {*vs.forced, *fill})
    with opened(output) as f:
        if not no_header:
            f.write(header(vs, fill, not no_version))
        if not header_only:
            for piece in in_order(lines(vs, fill), "line", "\n"):
                f.write(piece.decode())


def write_parts(vs: VariantSet, path: str, fill: Sequence[str] = ()) -> None:
    """Sorted part files on the cluster's storage and the header beside them; no driver in between."""
    vs = vs.with_mode(vs.mode, vs.view, {*vs.forced, *fill})
    lines(vs, fill).orderBy("variant_index").select("line").write.text(f"{path}/records")
    vs.df.sparkSession.createDataFrame([(header(vs, fill).rstrip("\n"),)], "value string").write.text(f"{path}/header")
