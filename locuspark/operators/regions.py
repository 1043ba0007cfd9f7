"""Region overlap and target match as semi and anti joins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (contig, start, end): 1-based, closed; None is open.
Interval = tuple[str, int | None, int | None]
#: Intervals up to which the test is a literal condition, and rows up to which a table of their bins is broadcast.
LITERAL, BROADCAST = 32, 1_000_000
BIN = 1 << 14
OPEN = 1 << 62


def parse(text: str) -> Interval:
    """``c``, ``c:p``, ``c:p-`` or ``c:a-b``; only the last colon separates."""
    if m := re.fullmatch(r"(.*):(\d+)-(\d*)", text, re.DOTALL):
        return m[1], int(m[2]), int(m[3]) if m[3] else None
    if m := re.fullmatch(r"(.*):(\d+)", text, re.DOTALL):
        return m[1], int(m[2]), int(m[2])
    return text, None, None


def from_option(text: str) -> tuple[list[Interval], bool]:
    """A comma list of regions, with ``^`` for the complement."""
    return [parse(r) for r in text.removeprefix("^").split(",")], text.startswith("^")


def from_file(path: str) -> tuple[list[Interval], bool]:
    """A tab-separated file of contig, start and end (1-based, closed); further columns are ignored."""
    rows: list[Interval] = []
    for line in Path(path.removeprefix("^")).read_text().splitlines():
        parts = line.split("\t")
        if len(parts) < 3:
            raise ValueError(f"a regions file needs three tab-separated columns: {line!r}")
        rows.append((parts[0], int(parts[1]), int(parts[2])))
    if not rows:
        raise ValueError(f"the regions file {path} is empty")
    return rows, path.startswith("^")


def intervals(given: str | Iterable, contigs: Sequence[str]) -> list[Interval]:
    """Intervals of a string, of strings, of triples or of a pandas table; every contig must be known."""
    if isinstance(given, str):
        given = [given]
    if hasattr(given, "itertuples"):
        given = [(r.contig, *(None if v is None or v != v or str(v) == "<NA>" else int(v) for v in (r.start, r.end))) for r in given.itertuples(index=False)]
    out = []
    for g in given:
        if isinstance(g, str):
            if g.startswith("^") or "," in g:
                raise ValueError(f"one region a string is expected: {g!r}")
            g = parse(g)
        if g[0] not in contigs:
            raise ValueError(f"{g[0]!r} is not in the list of contigs")
        out.append(tuple(g))
    return out


def merged(found: list[Interval]) -> list[tuple[str, int, int]]:
    """Disjoint intervals that cover the same positions."""
    out: list[list] = []
    for c, a, b in sorted((c, a or 0, OPEN if b is None else b) for c, a, b in found):
        if out and out[-1][0] == c and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([c, a, b])
    return [tuple(x) for x in out]


def _joined(df: DataFrame, found: list[Interval], past: Column, how: str) -> DataFrame:
    rows = merged(found)
    if len(rows) <= LITERAL:
        hit = F.lit(False)
        for c, a, b in rows:
            hit = hit | ((F.col("chrom") == c) & (F.col("pos") <= b) & (past >= a))
        return df.where(hit if how == "left_semi" else ~hit)
    # A variant asks one key: the bin it begins in, or -1 if it is longer than a bin. An interval
    # stands in every bin from one before its start, and under -1. So no row is ever spread.
    if any(b == OPEN for _, _, b in rows):
        top = int(df.agg(F.max(F.greatest("pos", past))).first()[0] or 0)
        rows = [(c, a, min(b, max(a, top))) for c, a, b in rows]
    size = sum(b // BIN - a // BIN + 3 for _, a, b in rows)
    table = df.sparkSession.createDataFrame(rows, "_c string, _a long, _b long")
    bins = F.sequence(F.greatest(F.floor(F.col("_a") / BIN) - 1, F.lit(0)), F.floor(F.col("_b") / BIN))
    table = table.select("_c", "_a", "_b", F.explode(F.concat(bins, F.array(F.lit(-1).cast("long")))).alias("_bin"))
    own = F.when(past - F.col("pos") < BIN, F.floor(F.col("pos") / BIN)).otherwise(F.lit(-1))
    met = (F.col("chrom") == F.col("_c")) & (own == F.col("_bin")) & (F.col("pos") <= F.col("_b")) & (past >= F.col("_a"))
    return df.join(F.broadcast(table) if size <= BROADCAST else table, met, how)


def overlapping(df: DataFrame, found: list[Interval], max_rlen: int = 1 << 30) -> DataFrame:
    """Variants whose ``pos`` to ``pos + rlen - 1`` overlap any interval, once each.

    A bound from the longest variant prunes row groups by ``pos`` alone.
    """
    rows = merged(found)
    if rows and len(rows) <= LITERAL:
        bound = F.lit(False)
        for c, a, b in rows:
            bound = bound | ((F.col("chrom") == c) & (F.col("pos") <= b) & (F.col("pos") >= a - max_rlen + 1))
        df = df.where(bound)
    return _joined(df, found, F.col("pos") + F.col("rlen") - 1, "left_semi")


def matching(df: DataFrame, found: list[Interval], complement: bool = False) -> DataFrame:
    """Variants whose ``pos`` lies in any interval, or in none."""
    return _joined(df, found, F.col("pos"), "left_anti" if complement else "left_semi")
