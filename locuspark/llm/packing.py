"""Variable-capacity best-fit packing of token sequences.

Permitted lengths are chosen jointly: a sequence costs its length plus a fixed
overhead plus an attention share that grows with the square of its length.
Each block of documents is packed by best fit decreasing under several opening
rules (open the least-cost length for what is left, or at least a given
length); every bin is downsized to the smallest permitted length that holds its
contents, and the rule of least total cost is kept.

Scale: only ids and lengths are shuffled. Documents with tokens fall into
blocks by hash, about ``BLOCK`` tokens and at most about ``ROWS`` rows each, so
that a block is bounded whatever the corpus is and its unfilled last bins are a
negligible share; equal rows are counted first and then spread like others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.frames import columns, map_text, written
from locuspark.llm.tokens import Runs, combine, raw

LENGTHS = (512, 1024, 2048, 4096, 8192)
BLOCK, ROWS = 8_000_000, 500_000
OVERHEAD, ATTENTION = 8.0, 0.05
#: How text is cut before byte pairs are merged: a fixed value of public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cost(length: int, largest: int) -> float:
    return length + OVERHEAD + ATTENTION * length * length / largest


def _pack(sizes: list[int], lengths: tuple[int, ...], opened: Callable[[int, int], int]) -> tuple[list[int], list[int], list[int]]:
    """Best fit of ``sizes`` (falling): bin and offset of each, and the contents of each bin."""
    free: dict[int, list[int]] = {}
    mask = 0
    place, offset, filled, room = [], [], [], []
    left = sum(sizes)
    for n in sizes:
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = free[gap].pop()
            if not free[gap]:
                mask &= ~(1 << gap)
        else:
            b, gap = len(filled), opened(n, left)
            filled.append(0)
            room.append(gap)
        place.append(b)
        offset.append(filled[b])
        filled[b] += n
        left -= n
        if gap > n:
            free.setdefault(gap - n, []).append(b)
            mask |= 1 << (gap - n)
    return place, offset, filled


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int], float]:
    """Bins of falling ``sizes``: bin and offset of each item, permitted length of each bin, total cost."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    fit = lambda n: next(c for c in lengths if c >= n)
    rules = [lambda n, left: min((c for c in lengths if c >= n), key=lambda c: cost(c, top) / min(c, left))]
    rules += [lambda n, left, c=c: max(c, fit(n)) for c in lengths]
    best = None
    for rule in rules:
        place, offset, filled = _pack(sizes, lengths, rule)
        caps = [fit(max(n, 1)) for n in filled]
        total = sum(cost(c, top) for c in caps)
        if best is None or total < best[3]:
            best = (place, offset, caps, total)
    return best


def token_counts(docs: DataFrame, tokenizer: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, salt`` for each row.

    Tokens are runs of word bytes and runs of other marks; ``tokenizer`` names
    a rank file of a public byte-pair tokenizer that counts instead, on every
    executor, and ``pattern`` how that one cuts text.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        runs = Runs(*raw(batch.column("text")), marks=True)
        bounds = runs.bounds(batch.num_rows)
        count = np.diff(bounds)
        if tokenizer:
            count = np.array([len(t) for t in encoder(tokenizer, pattern).encode_ordinary_batch([x or "" for x in batch.column("text").to_pylist()], num_threads=1)])
        salt = combine([runs.hash(runs.offsets[:-1], runs.offsets[1:])], 3).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "n_tokens": count, "salt": salt}

    return map_text(columns(docs, "doc_id", "text"), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, salt long")


def encoder(path: str, pattern: str, cache: dict = {}):  # noqa: B006  one in each worker
    if (path, pattern) not in cache:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[path, pattern]


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, block_tokens: int = BLOCK, tokenizer: str | None = None, block_rows: int = ROWS, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, piece, token_start, n_tokens, bin_id, bin_offset, capacity``: where each piece of each row goes.

    A document longer than the largest permitted length fills bins of that
    length and its rest is packed. Null and empty texts give one piece of no
    tokens without a bin (bin_id, bin_offset and capacity null); ties go by
    doc_id; repeated rows are packed as often as they occur.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = written(token_counts(docs, tokenizer, pattern), "lengths")
    some = counted.where("n_tokens > 0")
    seen = some.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).first()
    n_blocks = max(1, -(-(seen["tokens"] or 0) // block_tokens), -(-seen["rows"] // block_rows))
    top = max(lengths)
    # Equal rows share a hash: each gets a number, in two steps so that no array is long.
    step = 1 << 16
    equal = some.groupBy("doc_id", "n_tokens", "salt").agg(F.count("*").alias("n"))
    equal = equal.withColumn("many", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)")))
    spread = equal.select("doc_id", "n_tokens", "salt", F.explode(F.sequence("many", F.least(F.col("many") + step, "n") - 1)).alias("copy"))
    blocks = spread.select("doc_id", "n_tokens", "salt", F.pmod(F.xxhash64("doc_id", "salt", "copy"), F.lit(n_blocks)).alias("block"))
    schema = f"doc_id {kind}, piece int, token_start long, n_tokens long, bin_id long, bin_offset int, capacity int"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("salt", "ascending")])
        block = table["block"][0].as_py() << 32
        n = table["n_tokens"].to_numpy()
        whole, rest = n // top, n % top
        rest_at = np.argsort(-rest, kind="stable")
        rest_at = rest_at[rest[rest_at] > 0]
        place, offset, caps, _ = pack(rest[rest_at].tolist(), lengths)
        full = int(whole.sum())
        row = np.concatenate([np.repeat(np.arange(len(n)), whole), rest_at])
        piece = np.concatenate([np.arange(full) - np.repeat(np.cumsum(whole) - whole, whole), whole[rest_at]])
        size = np.concatenate([np.full(full, top), rest[rest_at]])
        bins = np.concatenate([len(caps) + np.arange(full), np.array(place, int)])
        off = np.concatenate([np.zeros(full, int), np.array(offset, int)])
        cap = np.concatenate([np.full(full, top), np.array(caps, int)[np.array(place, int)] if place else np.zeros(0, int)])
        return pa.table({
            "doc_id": table["doc_id"].take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "token_start": pa.array(piece * top, pa.int64()), "n_tokens": pa.array(size, pa.int64()),
            "bin_id": pa.array(block + bins, pa.int64()), "bin_offset": pa.array(off, pa.int32()), "capacity": pa.array(cap, pa.int32()),
        })

    none = [F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_offset", "int"), ("capacity", "int"))]
    empty = counted.where("n_tokens = 0").select("doc_id", F.lit(0).cast("int").alias("piece"), F.lit(0).cast("long").alias("token_start"), "n_tokens", *none)
    return blocks.groupBy("block").applyInArrow(one, schema).unionByName(empty)
