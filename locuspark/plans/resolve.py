"""Names to columns, stored or computed, over the cohort or the subset; and the filtered result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark import errors as E
from locuspark.functions import derived
from locuspark.functions.binding import lets
from locuspark.model import FIXED, Field, VariantSet
from locuspark.plans import expression as X
from locuspark.plans.compile import Value, combine, condition, truth, value

_KINDS = {"Integer": "int", "Float": "float", "String": "str", "Character": "str", "Flag": "flag"}
_UNSUPPORTED = ("N_SAMPLES", "MAC", "MAF", "ILEN")


def available(vs: VariantSet, key: str) -> bool:
    """Whether a virtual field's dependencies are there."""
    return key in derived.VIRTUAL and (not derived.VIRTUAL[key][2] or vs.has_genotypes)


def virtual_field(vs: VariantSet, key: str) -> Field:
    number, kind, _, text = derived.VIRTUAL[key]
    return Field("INFO", key, number, kind, vs.max_alleles - 1 if number == "A" else 1, text)


def computed(vs: VariantSet, key: str, for_filter: bool) -> bool:
    """Whether an INFO key is computed rather than read."""
    if not available(vs, key):
        return False
    if vs.stored("INFO", key) is None:
        return True
    if for_filter and vs.mode == "bcftools":
        return False
    if key in vs.forced:
        return True
    return vs.mode == "native" and vs.subset and derived.VIRTUAL[key][2]


def info(vs: VariantSet, key: str, for_filter: bool = False, bound: tuple[Column, Column] | None = None) -> tuple[Column, Field] | None:
    """Column and description of an INFO key; computed ones always follow the selected samples.

    ``bound``: genotypes and ALTs to compute from, where they are evaluated already.
    """
    own = vs.stored("INFO", key)
    if computed(vs, key, for_filter):
        made = derived.compute(key, *(bound or (vs.call("gt") if vs.has_genotypes else None, F.col("alts"))))
        field = virtual_field(vs, key)
        if own is not None and own.description:
            field = Field("INFO", key, field.number, field.type, field.width, own.description)
        return made, field
    return None if own is None else (F.col(own.column), own)


def _value(col: Column, field: Field) -> Value:
    shape = "V" if field.category == "INFO" else "G"
    if field.vector:
        if field.category == "FORMAT":
            raise E.UnsupportedHigherDimensionalFormatFieldsError(f"FORMAT/{field.key} has several values a sample")
        return Value(col, "A", _KINDS[field.type], field.width)
    return Value(col, shape, _KINDS[field.type])


def resolver(vs: VariantSet, bound: tuple[Column, Column] | None = None):
    """Names of filter expressions to values; ``bound`` as in :func:`info`."""

    def resolve(name: str) -> Value:
        prefix, _, key = name.rpartition("/")
        if key == "GT":
            raise E.UnsupportedHigherDimensionalFormatFieldsError("FORMAT/GT has several values a sample")
        if not prefix and key in ("POS", "QUAL", "ID"):
            return Value(F.col(FIXED[key]), "V", {"POS": "int", "QUAL": "float", "ID": "str"}[key])
        if not prefix and key == "REF":
            return Value(F.array("ref"), "A", "str", 1)
        if not prefix and key == "ALT":
            return Value(F.col("alts"), "A", "str", max(1, vs.max_alleles - 1))
        if not prefix and key == "variant_index":
            return Value(F.col("variant_index"), "V", "int")
        call = vs.stored("FORMAT", key) if prefix != "INFO" else None
        site = info(vs, key, True, bound) if prefix in ("", "INFO") else None
        if call is not None and site is not None:
            if key in derived.VIRTUAL and vs.stored("INFO", key) is None:
                site = None  # what is only computed does not compete with a stored field
            else:
                raise ValueError(f'ambiguous filtering expression: "{key}", both INFO/{key} and FORMAT/{key} are defined')
        if call is not None:
            return _value(vs.call(call.column, vs.view), call)
        if site is not None:
            return _value(*site)
        if key in _UNSUPPORTED:
            raise E.UnsupportedCalculatedVariableError(f"{key} is not supported")
        raise ValueError(f'the tag "{name}" is not defined')

    return resolve


def counts_genotypes(vs: VariantSet, tree) -> bool:
    """Whether ``tree`` has a field that is computed from genotypes."""
    keys = [key for prefix, _, key in (n.rpartition("/") for n in X.names(tree)) if prefix in ("", "INFO")]
    return any(computed(vs, k, True) and derived.VIRTUAL[k][2] for k in keys)


def decided(vs: VariantSet, tree, exclude: bool = False) -> Value:
    """The mask of one condition.

    Where fields are computed from genotypes, these and the ALTs are evaluated
    once a row, whatever number of fields there is: Spark moves a condition
    below the columns that it names, so each mention would compute them again.
    Tests of stored columns that have to hold anyway stay in front, so that
    they still prune the scan and spare the rest.
    """
    if not counts_genotypes(vs, tree):
        return condition(tree, resolver(vs), vs.filters, exclude)
    made: list[Value] = []

    def body(gt: Column, alts: Column) -> Column:
        made.append(condition(tree, resolver(vs, (gt, alts)), vs.filters, exclude))
        return made[-1].col

    col = lets((vs.call("gt"), F.col("alts")), body)
    out = replace(made[-1], col=col)
    if out.shape == "V" and not exclude and isinstance(tree, X.Logical) and tree.op[0] == "&":
        for operand in tree.operands:
            if not counts_genotypes(vs, operand) and (own := truth(value(operand, resolver(vs), vs.filters))).shape == "V":
                out = replace(out, col=own.col & out.col)
    return out


@dataclass(frozen=True)
class Result:
    """cells: the name of a mask column over the selected samples, if a filter looked at samples."""

    df: DataFrame
    cells: str | None = None


def mask(vs: VariantSet) -> Value | None:
    """All conditions of ``vs`` as one mask."""
    out: Value | None = None
    for given, exclude in vs.conditions:
        if callable(given):
            col = given(vs)
            v = col if isinstance(col, Value) else Value(F.coalesce(col, F.lit(False)), "V", "mask")
        else:
            v = decided(vs, X.parse(given), exclude)
        if out is None:
            out = v
        else:
            out = combine("&", out, v)
    return out


def result(vs: VariantSet) -> Result:
    """Rows that pass; with a sample filter also ``_cells``, taken down to the selected samples."""
    m = mask(vs)
    if m is None:
        return Result(vs.df)
    if m.shape != "G":
        return Result(vs.df.where(m.col))
    df = vs.df.withColumn("_cells", m.col).where(F.exists("_cells", lambda x: x))
    if vs.view and vs.chosen is not None:
        df = df.withColumn("_cells", replace(vs, block=None).call("_cells"))
    return Result(df, "_cells")


def project(vs: VariantSet, fields: list[str] | None = None) -> DataFrame:
    """Named fields (``POS``, ``INFO/X``, ``FORMAT/X``, ``GT``; None: every stored one) of the rows that pass."""
    vs = vs.reading(fields)
    out = result(vs)
    if fields is None:
        fields = [*FIXED, *(f"{f.category}/{f.key}" for f in vs.fields), *(["GT"] if vs.has_genotypes else [])]
    cols: dict[str, Column] = {} if "variant_index" in fields else {"variant_index": F.col("variant_index")}
    for name in fields:
        prefix, _, key = name.rpartition("/")
        if name == "variant_index":
            cols[name] = F.col(name)
        elif key == "GT":
            cols |= {c: vs.call(c) for c in ("gt", "phased") if vs.has(c)}
        elif name in FIXED:
            cols[FIXED[name]] = F.col(FIXED[name])
        elif prefix in ("FORMAT", "FMT") and (own := vs.stored("FORMAT", key)):
            cols[own.column] = vs.call(own.column)
        elif (own := info(vs, key)) is not None:
            cols[own[1].column] = own[0]
        else:
            raise KeyError(name)
    # Named in a second step: inside lambdas a name would mean the new column of that name, not the stored one.
    return out.df.select(*[c.alias(f"_{k}") for k, c in enumerate(cols.values())]).toDF(*cols)
