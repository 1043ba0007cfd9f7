"""Values computed once and used often inside one expression.

A lambda body is evaluated for every element, with everything it mentions. What
does not depend on the element is bound to a variable first, or rows with many
samples would cost their square.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def lets(values: Sequence[Column], body: Callable[..., Column]) -> Column:
    """``body`` of several values, each evaluated once a row."""
    if not values:
        return body()
    return let(values[0], lambda x: lets(values[1:], lambda *rest: body(x, *rest)))


def numbers(values: Sequence[int]) -> Column:
    """An array of integers as one literal, whatever its length."""
    return F.lit(np.array(values, np.int32)) if len(values) else F.array().cast("array<int>")


def names(values: Sequence[str]) -> Column:
    """An array of names (without tabs) as one literal."""
    return F.split(F.lit("\t".join(values)), "\t") if values else F.array().cast("array<string>")
