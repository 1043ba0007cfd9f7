"""Formats of ``query -f``: text with ``%TAG``, ``%TAG{i}`` and ``[ ]`` sample loops, compiled to one string column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuspark.functions import text as text_
from locuspark.functions.binding import let, lets, names
from locuspark.model import FIXED, VariantSet
from locuspark.plans.resolve import result

_PIECE = re.compile(r"%(?P<tag>(?:INFO/|FORMAT/|FMT/)?[A-Z][A-Za-z0-9_]*)(?:\{(?P<index>\d+)\})?|(?P<escape>\\[nt])|(?P<open>\[)|(?P<close>\])|(?P<literal>[^\\{}\[\]%]+)")


def parse(text: str) -> list:
    """Literals, ``(tag, index)`` pairs, and lists for sample loops."""
    out: list = []
    stack = [out]
    at = 0
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            raise ValueError(f"cannot read the format at {text[at:]!r}")
        at = m.end()
        if m["tag"]:
            if re.search("[a-z]", m["tag"]):
                raise ValueError(f"tags are upper case: %{m['tag']}")
            stack[-1].append((m["tag"], None if m["index"] is None else int(m["index"])))
        elif m["escape"]:
            stack[-1].append({"n": "\n", "t": "\t"}[m["escape"][1]])
        elif m["open"]:
            if len(stack) > 1:
                raise ValueError("sample loops do not nest")
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif m["close"]:
            if len(stack) == 1:
                raise ValueError("unmatched ]")
            stack.pop()
        else:
            stack[-1].append(m["literal"])
    if len(stack) > 1:
        raise ValueError("unmatched [")
    return out


def genotype_text(gt: Column, phased: Column) -> Column:
    """``0|1``: NULL alleles as dots; a call has as many alleles as its ploidy."""
    alleles = F.transform(gt, lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    return F.when(F.coalesce(phased, F.lit(False)), F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))


def _joined(parts: Column, sep: str = ",") -> Column:
    """A site-level vector: a dot where it is empty or wholly missing."""
    return let(parts, lambda own: F.when(F.forall(own, lambda x: x.isNull()), ".").otherwise(F.array_join(F.transform(own, lambda x: F.coalesce(x, F.lit("."))), sep)))


def _site(vs: VariantSet, tag: str) -> tuple[Column, bool]:
    """Text (or array of texts) of a site-level tag, NULL where missing; whether it is an array."""
    prefix, _, key = tag.rpartition("/")
    if not prefix and key in FIXED:
        col = F.col(FIXED[key])
        if key == "QUAL":
            return text_.general(col), False
        return (col, True) if key in ("ALT", "FILTER") else (col.cast("string"), False)
    own = vs.stored("INFO", key) if prefix in ("", "INFO") else None
    if own is None:
        if prefix != "INFO" and (vs.stored("FORMAT", key) or key in ("GT", "SAMPLE")):
            raise ValueError(f'no such tag defined: INFO/{key}. FORMAT fields must be enclosed in square brackets, e.g. "[ %{key}]"')
        raise ValueError(f"No mapping found for '{tag}'")
    kind = vs.kind(own.column)
    return text_.texts(F.col(own.column), kind), isinstance(kind, T.ArrayType)


def _tag(vs: VariantSet, tag: str, index: int | None) -> Column:
    if tag in ("GT", "SAMPLE"):
        raise ValueError(f'no such tag defined: INFO/{tag}. FORMAT fields must be enclosed in square brackets, e.g. "[ %{tag}]"')
    col, many = _site(vs, tag)
    if index is not None:
        one = F.get(col, F.lit(index)) if many else (F.get(F.split(col, ""), F.lit(index)))
        return F.coalesce(one, F.lit("."))
    return _joined(col, ";" if tag == "FILTER" else ",") if many else F.coalesce(col, F.lit("."))


def _in_loop(vs: VariantSet, tag: str, index: int | None) -> tuple[Column, bool]:
    """Text of a tag inside a loop, and whether it is an array over samples."""
    prefix, _, key = tag.rpartition("/")
    if index is not None:
        raise ValueError("subscripts are not allowed in sample loops")
    if tag == "SAMPLE":
        return names(vs.sample_ids), True
    if key == "GT" and prefix != "INFO":
        if not vs.has("phased"):
            raise NotImplementedError("genotypes without phase")
        return F.zip_with(vs.call("gt"), vs.call("phased"), genotype_text), True
    own = vs.stored("FORMAT", key) if prefix != "INFO" else None
    if own is None:
        col, many = _site(vs, tag)
        return (_joined(col, ";" if tag == "FILTER" else ",") if many else F.coalesce(col, F.lit("."))), False
    kind = vs.kind(own.column).elementType
    parts = text_.texts(vs.call(own.column), T.ArrayType(kind))
    if isinstance(kind, T.ArrayType):
        return F.transform(parts, lambda v: F.when(v.isNull() | (F.size(v) == 0), ".").otherwise(F.array_join(F.transform(v, lambda x: F.coalesce(x, F.lit("."))), ","))), True
    return F.transform(parts, lambda x: F.coalesce(x, F.lit("."))), True


def _loop(vs: VariantSet, parts: list, cells: str | None) -> Column:
    """The text of a loop: parts over samples are zipped, the others bound once."""
    if not vs.sample_ids:
        return F.lit("")
    made = [(F.lit(p), False) if isinstance(p, str) else _in_loop(vs, *p) for p in parts]
    places = F.sequence(F.lit(0), F.lit(len(vs.sample_ids) - 1)).alias("at")
    zipped = F.arrays_zip(places, *([F.col(cells).alias("in")] if cells else []), *[c.alias(f"p{k}") for k, (c, many) in enumerate(made) if many])
    if cells:
        zipped = F.filter(zipped, lambda z: F.coalesce(z["in"], F.lit(False)))
    fixed = [k for k, (_, many) in enumerate(made) if not many and not isinstance(parts[k], str)]

    def text(*bound: Column) -> Column:
        def one(z: Column) -> Column:
            return F.concat(*[z[f"p{k}"] if many else bound[fixed.index(k)] if k in fixed else c for k, (c, many) in enumerate(made)])

        return F.array_join(F.transform(zipped, one), "")

    return lets([made[k][0] for k in fixed], text)


def formatted(vs: VariantSet, text: str, newline: bool = True) -> DataFrame:
    """``variant_index, text`` of the rows that pass; a newline ends each unless the format has one or ``newline`` is off."""
    if newline and "\\n" not in text:
        text += "\\n"
    parts = parse(text)
    vs = vs.reading([p[0] for part in parts for p in (part if isinstance(part, list) else [part]) if not isinstance(p, str)])
    out = result(vs)
    cols = [F.lit(p) if isinstance(p, str) else _loop(vs, p, out.cells) if isinstance(p, list) else _tag(vs, *p) for p in parts]
    return out.df.select("variant_index", F.concat(*cols).alias("text"))
