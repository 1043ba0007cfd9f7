"""Sample selection by name, complement or position; resolved on the driver."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from pathlib import Path


def chosen(cohort: Sequence[str], names: Sequence[str], complement: bool = False, ignore_missing: bool = False) -> tuple[int, ...]:
    """Positions of ``names`` in their order, or of all others in cohort order."""
    place = {s: i for i, s in enumerate(cohort)}
    if "" in names:
        raise ValueError("an empty sample name cannot be selected")
    unknown = [n for n in names if n not in place]
    if unknown:
        text = f"subset called for sample(s) not in header: {','.join(unknown)}"
        if not ignore_missing:
            raise ValueError(text + '. Use "--force-samples" to ignore this error.')
        warnings.warn(text, stacklevel=3)
        names = [n for n in names if n in place]
    if complement:
        out = set(names)
        return tuple(i for i, s in enumerate(cohort) if s not in out)
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate sample(s): {','.join(sorted({n for n in names if list(names).count(n) > 1}))}")
    return tuple(place[n] for n in names)


def checked(indexes: Sequence[int], n: int) -> tuple[int, ...]:
    """Raw positions; repeats are allowed."""
    bad = [i for i in indexes if not 0 <= i < n]
    if bad:
        raise ValueError(f"sample index out of range: {bad[0]} (of {n})")
    return tuple(int(i) for i in indexes)


def from_file(path: str) -> tuple[list[str], bool]:
    """Names of a samples file, one a line, and whether a ``^`` before the path asks for the complement."""
    complement = path.startswith("^")
    lines = Path(path.removeprefix("^")).read_text(encoding="utf-8").splitlines()
    return [line.strip() for line in lines if line.strip()], complement


def from_option(text: str) -> tuple[list[str], bool]:
    """A comma list, with ``^`` for the complement."""
    return [s for s in text.removeprefix("^").split(",") if s], text.startswith("^")
