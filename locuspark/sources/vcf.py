"""VCF text files as variant sets."""

from __future__ import annotations

import re
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.functions.binding import let
from locuspark.model import Field, VariantSet

_TYPES = {"Integer": "int", "Float": "float", "String": "string", "Character": "string"}
_META = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')


def header(lines: list[str]) -> dict:
    """Fields, contigs, filters, samples and other lines of a header."""
    out: dict = {"fields": [], "contigs": [], "lengths": [], "filters": [], "texts": [], "meta": [], "source": None, "samples": ()}
    for line in lines:
        if line.startswith("#CHROM"):
            out["samples"] = tuple(line.split("\t")[9:])
            continue
        key, _, value = line.removeprefix("##").partition("=")
        about = {k: v.strip('"') for k, v in _META.findall(value[1:-1])} if value.startswith("<") else {}
        if key in ("INFO", "FORMAT") and about.get("ID") != "GT":
            n, kind = about.get("Number", "1"), about.get("Type", "String")
            out["fields"].append(Field(key, about["ID"], "0" if kind == "Flag" else n, kind, int(n) if n.isdigit() and int(n) > 1 else 1, about.get("Description")))
        elif key == "contig":
            out["contigs"].append(about["ID"])
            out["lengths"].append(about.get("length"))
        elif key == "FILTER":
            out["filters"].append(about["ID"])
            out["texts"].append(about.get("Description", ""))
        elif key == "source":
            out["source"] = value
        elif key not in ("INFO", "FORMAT", "fileformat"):
            out["meta"].append((key, value))
    return out


def _one(text: Column, kind: str) -> Column:
    own = F.when(text.isin(".", ""), None).otherwise(text)
    return own if _TYPES[kind] == "string" else own.try_cast(_TYPES[kind])


def _values(text: Column, field: Field) -> Column:
    """A vector; one that is not there has a single missing value."""
    return F.when(text.isNull(), F.array(F.lit(None).cast(_TYPES[field.type]))).otherwise(F.transform(F.split(text, ","), lambda x: _one(x, field.type)))


def _info(field: Field) -> Column:
    if field.number == "0":
        return F.map_contains_key("i", field.key)
    text = F.col("i")[field.key]
    return _values(text, field) if field.vector else _one(text, field.type)


def _place(key: str) -> Column:
    """Where ``key`` stands in the FORMAT column; -1: nowhere."""
    return (F.coalesce(F.array_position("keys", key), F.lit(0)) - 1).cast("int")


def _format(field: Field) -> Column:
    def calls(at: Column) -> Column:
        text = lambda s: F.when(at >= 0, F.get(s, F.greatest(at, F.lit(0))))
        return F.transform("calls", lambda s: _values(text(s), field) if field.vector else _one(text(s), field.type))

    return let(_place(field.key), calls)


def _measured(lines: DataFrame, open_ended: list[Field]) -> tuple[list, dict]:
    """One pass over the text: where the lines of each split stand, one row a split, and the widths of what is open-ended."""
    parts = F.split("value", "\t")
    info = F.split(F.get(parts, F.lit(7)), ";")
    slots = lambda text: F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) + 1
    end = F.regexp_extract(F.get(parts, F.lit(7)), "(?:^|;)END=([0-9]+)", 1).try_cast("long")
    widths = {"alts": F.when(F.get(parts, F.lit(4)) == ".", 0).otherwise(slots(F.get(parts, F.lit(4)))), "rlen": F.coalesce(end - F.get(parts, F.lit(1)).cast("long") + 1, F.length(F.get(parts, F.lit(3))))}
    for k, f in enumerate(open_ended):
        if f.category == "INFO":
            widths[f"w{k}"] = F.array_max(F.transform(info, lambda x, f=f: F.when(F.startswith(x, F.lit(f"{f.key}=")), slots(x)).otherwise(F.lit(1))))
        else:
            at = (F.coalesce(F.array_position(F.split(F.get(parts, F.lit(8)), ":"), f.key), F.lit(0)) - 1).cast("int")
            calls = F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0)))
            widths[f"w{k}"] = F.when(at >= 0, F.array_max(F.transform(calls, lambda c, at=at: slots(F.coalesce(F.get(F.split(c, ":"), F.greatest(at, F.lit(0))), F.lit(""))))))
    found = lines.groupBy("_f", "_s").agg(F.count("*").alias("n"), F.min("_m").alias("low"), F.max("_m").alias("high"), *[F.max(c).alias(n) for n, c in widths.items()])
    rows = found.orderBy("_f", "_s").collect()
    return rows, {n: max((r[n] or 0 for r in rows), default=0) for n in widths}


def _numbered(lines: DataFrame, counts: list) -> DataFrame:
    """Data lines with their place in the files."""
    spark = lines.sparkSession
    # The row numbers of a split need not be dense after the filter, so they are ranked by the line's place within it.
    base, rows = 0, []
    for r in counts:
        rows.append((r["_f"], r["_s"], base - r["low"] if r["high"] - r["low"] + 1 == r["n"] else None))
        base += r["n"]
    if any(r[2] is None for r in rows):
        raise ValueError("comment and blank lines may only stand at the start of a file")
    if not rows:
        return lines.select(F.lit(0).cast("long").alias("variant_index"), "value").limit(0)
    table = F.broadcast(spark.createDataFrame(rows, "_f string, _s long, _base long"))
    return lines.join(table, ["_f", "_s"]).select((F.col("_m") + F.col("_base")).alias("variant_index"), "value")


def read(spark: SparkSession, path: str) -> VariantSet:
    """The variants of one VCF file or of several with one header (plain or compressed as Spark reads text)."""
    about = header([r["value"] for r in takewhile(lambda r: r["value"].startswith("#"), spark.read.text(path).toLocalIterator())])
    n = len(about["samples"])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m")).where("value != '' and not startswith(value, '#')")
    open_ended = [f for f in about["fields"] if f.vector and not f.number.isdigit()]
    counts, seen = _measured(lines, open_ended)
    raw = _numbered(lines, counts).select("variant_index", F.split("value", "\t").alias("c"))
    info = F.expr("filter(transform(split(c[7], ';'), x -> struct(substring_index(x, '=', 1) as k, if(instr(x, '=') > 0, substr(x, instr(x, '=') + 1), null) as v)), x -> x.k != '.')")
    calls = F.slice("c", 10, n) if n else F.array().cast("array<string>")
    df = raw.select("variant_index", "c", F.map_from_entries(info).alias("i"), F.split(F.get("c", F.lit(8)), ":").alias("keys"), F.transform(calls, lambda s: F.split(s, ":")).alias("calls"))
    alts = F.when(F.get("c", F.lit(4)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("c", F.lit(4)), ","))
    filters = F.when(F.get("c", F.lit(6)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("c", F.lit(6)), ";"))
    ref = F.get("c", F.lit(3))
    cols = [
        F.col("variant_index"), F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("long").alias("pos"),
        F.coalesce(F.col("i")["END"].try_cast("long") - F.get("c", F.lit(1)).cast("long") + 1, F.length(ref)).cast("int").alias("rlen"),
        _one(F.get("c", F.lit(2)), "String").alias("id"), ref.alias("ref"), alts.alias("alts"), _one(F.get("c", F.lit(5)), "Float").alias("qual"), filters.alias("filters"),
    ]
    cols += [(_info(f) if f.category == "INFO" else _format(f)).alias(f.column) for f in about["fields"]]
    if n:
        at = _place("GT")
        gt = F.transform("calls", lambda s: F.coalesce(F.when(at >= 0, F.get(s, F.greatest(at, F.lit(0)))), F.lit("./.")))
        cols.append(F.transform(gt, lambda g: F.transform(F.split(g, "[/|]"), lambda a: a.try_cast("tinyint"))).alias("gt"))
        cols.append(F.transform(gt, lambda g: F.instr(g, "|") > 0).alias("phased"))
    df = df.select(*cols)
    wide = {f: max(1, seen[f"w{k}"] or 1) for k, f in enumerate(open_ended)}
    fields = tuple(Field(f.category, f.key, f.number if f.number != "." else str(wide[f]) if wide[f] > 1 else ".", f.type, wide.get(f, f.width), f.description) for f in about["fields"])
    contigs = about["contigs"] or [r["chrom"] for r in df.select("chrom").distinct().orderBy("chrom").collect()]
    lengths = tuple(int(x) for x in about["lengths"]) if about["lengths"] and all(about["lengths"]) else None
    names = about["filters"] if "PASS" in about["filters"] else ["PASS", *about["filters"]]
    texts = about["texts"] if "PASS" in about["filters"] else ["All filters passed", *about["texts"]]
    return VariantSet(df, about["samples"], tuple(contigs), tuple(names), fields, lengths, tuple(texts), about["source"], tuple(about["meta"]), 1 + (seen["alts"] or 1), seen["rlen"] or 1)
