"""Small variant sets for tests. -1 stands for missing, -2 for padding."""

from __future__ import annotations

from pyspark.sql import types as T

from locuspark.model import Field, VariantSet

_TYPES = {"Integer": T.IntegerType(), "Float": T.FloatType(), "String": T.StringType(), "Flag": T.BooleanType()}


def plain(x):
    """Nested lists with NULLs, and without padding."""
    if isinstance(x, (list, tuple)):
        return [plain(e) for e in x if e != -2]
    return None if x == -1 and not isinstance(x, bool) else x


def made(spark, n: int, info: dict | None = None, calls: dict | None = None, fixed: dict | None = None, **about) -> VariantSet:
    """``n`` variants; ``info`` and ``calls``: key to (values, type); ``fixed``: model columns."""
    info, calls, fixed = info or {}, calls or {}, fixed or {}
    fields, columns = [], {}
    fixed = {"chrom": ["1"] * n, "pos": list(range(1, n + 1)), "rlen": [1] * n, "id": [None] * n, "ref": ["A"] * n, "alts": [["T"]] * n, "qual": [None] * n, "filters": [[]] * n} | fixed
    kinds = {"chrom": T.StringType(), "pos": T.LongType(), "rlen": T.IntegerType(), "id": T.StringType(), "ref": T.StringType(), "alts": T.ArrayType(T.StringType()), "qual": T.FloatType(), "filters": T.ArrayType(T.StringType()), "gt": T.ArrayType(T.ArrayType(T.ByteType())), "phased": T.ArrayType(T.BooleanType())}
    columns = {k: (v, kinds[k]) for k, v in fixed.items()}
    samples = about.pop("samples", None)
    for category, group in (("INFO", info), ("FORMAT", calls)):
        for key, (values, kind, *more) in group.items():
            width = max((len(v) for row in values for v in ([row] if category == "INFO" else row) if isinstance(v, list)), default=0)
            number = more[0] if more else "0" if kind == "Flag" else str(width) if width > 1 else "A" if width == 1 else "1"
            field = Field(category, key, number, kind, max(width, 1), *more[1:])
            fields.append(field)
            one = T.ArrayType(_TYPES[kind]) if field.vector else _TYPES[kind]
            columns[field.column] = (values, one if category == "INFO" else T.ArrayType(one))
            if category == "FORMAT" and samples is None:
                samples = tuple(f"S{i}" for i in range(len(values[0])))
    if samples is None:
        samples = tuple(f"S{i}" for i in range(len(fixed["gt"][0]))) if fixed.get("gt") else ()
    schema = T.StructType([T.StructField("variant_index", T.LongType()), *[T.StructField(k, t) for k, (_, t) in columns.items()]])
    rows = [(k, *[plain(v[k]) if c not in ("filters", "alts") else list(v[k]) for c, (v, _) in columns.items()]) for k in range(n)]
    contigs = about.pop("contigs", tuple(dict.fromkeys(fixed["chrom"])))
    about.setdefault("max_alleles", 1 + max((len(a) for a in fixed["alts"]), default=1))
    return VariantSet(spark.createDataFrame(rows, schema), tuple(samples), contigs, fields=tuple(fields), **about)


NAMES = ("ana", "bo", "cyd", "dee")
#: chrom, pos, id, ref, alts, qual, filters, calls, and fields by key; nothing stands for missing.
ROWS = [
    ("chr3", 40, "tul1", "G", ["C"], 12.5, ["PASS"], "0|0 0|1 1|0 0/0", {"TD": 21, "PF": [0.25, -1], "ORI": "field", "NOV": True, "CNT": [2, -1], "td": [6, 4, 9, 2], "ql": [30, 11, 45, 8], "rr": [[1, 2], [3, 4], [5, 6], [7, 8]]}),
    ("chr3", 41, None, "T", ["TA", "G"], 99.0, ["thin", "odd"], "1/2 0/0 ./. 2|1", {"TD": 7, "PF": [0.1, 0.4], "CNT": [2, 2], "td": [-1, 3, 1, 3], "ql": [-1, 20, 19, 21], "rr": [[-1, -1], [9, -1], [4, 4], [2, 0]]}),
    ("chr3", 900, "tul2", "AC", ["A"], None, [], "0/0 0/0 0/0 0/1", {"NOV": True, "ql": [50, 50, 50, 2]}),
    ("chr3", 5000, None, "C", [], 3.0, ["thin"], "./. ./. 0/0 0|0", {"TD": 0, "ORI": "lab", "td": [-1, -1, 12, 15]}),
    ("chr8", 7, "tul3", "A", ["G"], 30.0, ["PASS"], "1|1 1|1 0/1 .|1", {"TD": 40, "PF": [0.875, -1], "ORI": "field", "CNT": [6, -1], "td": [11, 10, 9, 10], "ql": [5, 60, 33, 34]}),
    ("chr8", 350, None, "GGT", ["G", "GGTGT", "<DEL>"], 61.25, ["odd"], "3/1 2/2 0/3 0/0", {"TD": 18, "NOV": True, "CNT": [1, 2], "td": [4, 5, 4, 5], "ql": [41, 42, 43, 44], "rr": [[8, 8], [8, 8], [8, 8], [8, 8]]}),
    ("chr8", 352, "tul4", "T", ["A"], 30.0, ["PASS"], "0|0 0|0 0|0 0|0", {"TD": 33, "PF": [0.0, -1], "CNT": [0, -1], "td": [8, 8, 8, 9], "ql": [12, 13, 14, 15]}),
    ("chr8", 88000, None, "C", ["T"], 0.5, ["thin"], "0/1 0/1 ./. ./.", {"ORI": "shed", "td": [2, 2, -1, -1], "ql": [99, 98, -1, -1]}),
    ("chrY", 3, "tul5", "G", ["T"], 47.0, [], "1 0 1 .", {"TD": 9, "NOV": True, "CNT": [2, -1], "td": [5, 1, 3, 0], "ql": [22, 21, 20, -1]}),
    ("chrY", 60, None, "A", ["AT"], 8.0, ["PASS"], "0 0 1 1", {"PF": [0.5, -1], "ORI": "lab", "ql": [1, 2, 3, 4]}),
]
ABOUT = {"TD": "Reads at the site", "PF": "Share in the population", "ORI": "Where it was found", "NOV": "Seen here first", "CNT": "Copies seen"}
ABOUT_CALLS = {"td": "Reads of the sample", "ql": "Trust in the call", "rr": "Reads by strand"}


def calls(text: str) -> list[list[int]]:
    """Alleles of each call of a row."""
    return [[-1 if a == "." else int(a) for a in c.replace("|", "/").split("/")] for c in text.split()]


def tulips(spark) -> VariantSet:
    """Ten invented variants of four samples."""
    get = lambda key, empty: [r[8].get(key, empty) for r in ROWS]
    no = [-1] * 4
    return made(
        spark, len(ROWS),
        info={"TD": (get("TD", -1), "Integer", "1", ABOUT["TD"]), "PF": (get("PF", [-1, -1]), "Float", "2", ABOUT["PF"]), "ORI": (get("ORI", -1), "String", "1", ABOUT["ORI"]), "NOV": (get("NOV", False), "Flag", "0", ABOUT["NOV"]), "CNT": (get("CNT", [-1, -1]), "Integer", "2", ABOUT["CNT"])},
        calls={"TD": (get("td", no), "Integer", "1", ABOUT_CALLS["td"]), "QL": (get("ql", no), "Integer", "1", ABOUT_CALLS["ql"]), "RR": (get("rr", [[-1, -1]] * 4), "Integer", "2", ABOUT_CALLS["rr"])},
        fixed={
            "chrom": [r[0] for r in ROWS], "pos": [r[1] for r in ROWS], "rlen": [len(r[3]) for r in ROWS], "id": [r[2] for r in ROWS], "ref": [r[3] for r in ROWS], "alts": [r[4] for r in ROWS], "qual": [r[5] for r in ROWS], "filters": [r[6] for r in ROWS],
            "gt": [calls(r[7]) for r in ROWS], "phased": [["|" in c or "/" not in c for c in r[7].split()] for r in ROWS],
        },
        samples=NAMES, contigs=("chr3", "chr8", "chrY"), filters=("PASS", "thin", "odd"), filter_descriptions=("All filters passed", "Few reads", "Looks odd"), source="a garden", max_alleles=4, max_rlen=3, meta=(("fileDate", "20240229"), ("season", "spring")),
    )
