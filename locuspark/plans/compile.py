"""Filter trees to columns.

Every value has a shape: S constant, V one a variant, A one a slot of an INFO
vector, G one a sample. Masks are never NULL: a comparison decides at once what
missing means. Masks over A have the declared width, with False in slots that
do not exist, so that element-wise operators meet arrays of equal length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from locuspark.functions import derived
from locuspark.functions.binding import let, lets, names, numbers
from locuspark.plans import expression as X


@dataclass(frozen=True)
class Value:
    """col: scalar or array; kind: int, float, str, flag or mask; width: slots of A."""

    col: Column
    shape: str
    kind: str
    width: int = 1

    @property
    def sample(self) -> bool:
        return self.shape == "G"


Resolver = Callable[[str], Value]


def _wide(c: Column, kind: str) -> Column:
    return c.cast("double") if kind == "float" else c.cast("bigint") if kind in ("int", "flag", "mask") else c


def _compared(op: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """The M-rules for one pair of elements."""
    a, b = _wide(a, kinds[0]), _wide(b, kinds[1])
    if "float" in kinds:
        a, b = a.cast("double"), b.cast("double")
        number = ~(F.coalesce(F.isnan(a), F.lit(False)) | F.coalesce(F.isnan(b), F.lit(False)))
    else:
        number = F.lit(True)
    if op == "=":
        return a.eqNullSafe(b) & number
    if op == "!=":
        return ~(a.eqNullSafe(b) & number)
    test = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return F.coalesce(test, F.lit(False)) & number


def _divided(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / b)


def _calculated(op: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    a, b = _wide(a, kinds[0]), _wide(b, kinds[1])
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: _divided(a, b)}[op]()


_CLASH = "operands with different per-allele or per-sample axes have no common element"


def compare(op: str, a: Value, b: Value) -> Value:
    kinds = (a.kind, b.kind)
    if ("str" in kinds) and kinds != ("str", "str"):
        raise ValueError("cannot compare a string with a number")
    two = [v for v in (a, b) if v.shape in "AG"]
    if len(two) == 2 and (a.shape != b.shape or a.width != b.width):
        raise ValueError(f"cannot compare fields with incompatible dimensions: {_CLASH}")
    if not two:
        return Value(_compared(op, a.col, b.col, kinds), "V" if "V" in (a.shape, b.shape) else "S", "mask")
    if two[0].shape == "G":
        return Value(_each(a, b, lambda x, y: _compared(op, x, y, kinds)), "G", "mask")

    def slots(x: Column, y: Column) -> Column:
        def one(i: Column) -> Column:
            there, ends = F.lit(True), []
            for v, col in ((a, x), (b, y)):
                if v.shape == "A":
                    there = there & (i < F.size(col))
                ends.append(F.get(col, i) if v.shape == "A" else col)
            return there & _compared(op, *ends, kinds)

        return F.transform(_slots(two[0].width), one)

    return Value(lets((a.col, b.col), slots), "A", "mask", two[0].width)


def _slots(width: int) -> Column:
    return numbers(range(width))


def _each(a: Value, b: Value, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` over the elements of two values of which one at least is an array; a single one meets every element."""
    if a.shape in "AG" and b.shape in "AG":
        return F.zip_with(a.col, b.col, fn)
    if a.shape in "AG":
        return let(b.col, lambda y: F.transform(a.col, lambda x: fn(x, y)))
    return let(a.col, lambda x: F.transform(b.col, lambda y: fn(x, y)))


def calculate(op: str, a: Value, b: Value) -> Value:
    kinds = (a.kind, b.kind)
    if "str" in kinds:
        raise ValueError("cannot calculate with strings")
    kind = "float" if "float" in kinds or op == "/" else "int"
    fn = lambda x, y: _calculated(op, x, y, kinds)
    two = [v for v in (a, b) if v.shape in "AG"]
    if not two:
        return Value(fn(a.col, b.col), "V" if "V" in (a.shape, b.shape) else "S", kind)
    if len(two) == 1:
        return Value(_each(a, b, fn), two[0].shape, kind, two[0].width)
    if a.shape != b.shape or (a.width != b.width and 1 not in (a.width, b.width)):
        raise ValueError("cannot combine fields with incompatible dimensions: operands with different value counts have no common element")
    if a.width == b.width:
        return Value(lets((a.col, b.col), lambda x, y: F.slice(F.zip_with(x, y, fn), F.lit(1), F.least(F.size(x), F.size(y)))), a.shape, kind, a.width)

    def single(x: Column, y: Column) -> Column:
        few, many = (x, y) if a.width == 1 else (y, x)
        first = F.get(few, F.lit(0))
        made = F.transform(many, (lambda e: fn(first, e)) if a.width == 1 else (lambda e: fn(e, first)))
        return F.when(F.size(few) == 0, F.slice(made, 1, 0)).otherwise(made)

    return Value(lets((a.col, b.col), single), "A", kind, max(a.width, b.width))


def truth(v: Value) -> Value:
    """A mask; a bare number counts as true unless it is zero, a missing one too."""
    if v.kind == "mask":
        return v
    if v.kind == "str":
        raise ValueError("a string is not a condition")
    one = lambda x: F.coalesce(_wide(x, v.kind) != 0, F.lit(True))
    if v.shape in "SV":
        return Value(one(v.col), v.shape, "mask")
    if v.shape == "G":
        return Value(F.transform(v.col, one), "G", "mask")
    # A padding slot holds a negative sentinel in the stored form, which is not zero.
    return Value(let(v.col, lambda own: F.transform(_slots(v.width), lambda i: one(F.get(own, i)))), "A", "mask", v.width)


def some(v: Value) -> Value:
    """An A or G mask as one decision a variant."""
    return v if v.shape in "SV" else Value(F.exists(v.col, lambda x: x), "V", "mask")


def combine(op: str, a: Value, b: Value) -> Value:
    fn = (lambda x, y: x & y) if op[0] == "&" else (lambda x, y: x | y)
    shape = next((s for s in "GAV" if s in (a.shape, b.shape)), "S")
    width = max(a.width, b.width)
    if shape in "SV":
        return Value(fn(a.col, b.col), shape, "mask")
    if len(op) == 1 or "S" in (a.shape, b.shape):
        return Value(_each(a, b, fn), shape, "mask", width)

    def site(x: Column, y: Column) -> Column:
        """A site passes as a whole; its cells are those of either side for ``&&``, all of them for ``||``."""
        own_a, own_b = Value(x, a.shape, "mask", a.width), Value(y, b.shape, "mask", b.width)
        either = _each(own_a, own_b, lambda p, q: p | q)
        return let(fn(some(own_a).col, some(own_b).col), lambda passes: F.transform(either, lambda c: fn(c, passes)))

    return Value(lets((a.col, b.col), site), shape, "mask", width)


def special(tree: X.Special, filters: tuple[str, ...]) -> Value:
    if tree.name == "CHROM":
        hit = F.coalesce(F.col("chrom") == tree.value, F.lit(False))
        return Value(hit if tree.op == "=" else ~hit, "V", "mask")
    if tree.name == "TYPE":
        hit = derived.type_mask(F.col("ref"), F.col("alts"), tree.value, "~" in tree.op)
        return Value(~hit if "!" in tree.op else hit, "V", "mask")
    want = [] if tree.value == "." else tree.value.split(";")
    if unknown := [f for f in want if f not in filters]:
        raise ValueError(f"the filter {unknown[0]!r} is not defined in the header")
    given = names(want)
    hit = F.size(F.array_except(given, F.col("filters"))) == 0
    if "~" not in tree.op:
        hit = hit & (F.size(F.array_except(F.col("filters"), given)) == 0)
    return Value(~hit if "!" in tree.op else hit, "V", "mask")


def value(tree, resolve: Resolver, filters: tuple[str, ...] = ()) -> Value:
    """The value of any tree."""
    go = lambda t: value(t, resolve, filters)
    if isinstance(tree, X.Number):
        return Value(F.lit(tree.value), "S", "int" if isinstance(tree.value, int) else "float")
    if isinstance(tree, X.String):
        return Value(F.lit(tree.value), "S", "str")
    if isinstance(tree, X.Name):
        return resolve(tree.value)
    if isinstance(tree, X.Special):
        return special(tree, filters)
    if isinstance(tree, X.Negative):
        v = go(tree.of)
        if v.kind == "str":
            raise ValueError("cannot calculate with strings")
        kind = "float" if v.kind == "float" else "int"
        return Value(-_wide(v.col, v.kind) if v.shape in "SV" else F.transform(v.col, lambda x: -_wide(x, v.kind)), v.shape, kind, v.width)
    if isinstance(tree, X.Arithmetic):
        out = go(tree.first)
        for op, operand in tree.rest:
            out = calculate(op, out, go(operand))
        return out
    if isinstance(tree, X.Comparison):
        return compare(tree.op, go(tree.left), go(tree.right))
    masks = [truth(go(t)) for t in tree.operands]
    if any(m.shape == "G" for m in masks) or len({m.width for m in masks if m.shape == "A"}) > 1:
        masks = [some(m) if m.shape == "A" else m for m in masks]
    out = masks[0]
    for m in masks[1:]:
        out = combine(tree.op, out, m)
    return out


def inverted(v: Value) -> Value:
    """Exclusion: every cell is inverted before any collapse, slots that do not exist too."""
    return Value(~v.col if v.shape in "SV" else F.transform(v.col, lambda x: ~x), v.shape, "mask", v.width)


def condition(tree, resolve: Resolver, filters: tuple[str, ...] = (), exclude: bool = False) -> Value:
    """A mask over variants (V) or samples (G). At the root a bare field must be a flag."""
    v = value(tree, resolve, filters)
    if v.kind == "flag":
        v = Value(F.coalesce(v.col, F.lit(False)), v.shape, "mask")
    if v.kind != "mask":
        raise ValueError("the expression is not a condition")
    v = inverted(v) if exclude else v
    return some(v) if v.shape == "A" else Value(v.col, "V", "mask") if v.shape == "S" else v
