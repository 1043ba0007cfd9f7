"""Filters as objects: parsed once, asked for their scope and fields, attached to any variant set."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column

from locuspark.model import VariantSet
from locuspark.plans import expression as X
from locuspark.plans.compile import Value
from locuspark.plans.resolve import decided


class VariantFilter(Protocol):
    """What :meth:`VariantSet.with_filter` takes besides text: a callable to a Boolean column, or to a mask over samples."""

    def __call__(self, vs: VariantSet) -> Column | Value: ...


class FilterExpression:
    """An include or exclude expression of the filter language."""

    def __init__(self, include: str | None = None, exclude: str | None = None):
        if include is not None and exclude is not None:
            raise ValueError("Cannot handle both an include expression and an exclude expression")
        self.text, self.excludes = (include, False) if exclude is None else (exclude, True)
        self.tree = None if self.text is None else X.parse(self.text)

    @property
    def referenced_fields(self) -> frozenset[str]:
        return frozenset() if self.tree is None else frozenset(X.names(self.tree))

    def scope(self, vs: VariantSet) -> str:
        """``sample`` if the mask has a cell for each sample, else ``variant``."""
        return "sample" if self.tree is not None and self(vs).shape == "G" else "variant"

    def __call__(self, vs: VariantSet) -> Value:
        if self.tree is None:
            raise ValueError("an empty filter selects nothing in particular")
        return decided(vs, self.tree, self.excludes)
