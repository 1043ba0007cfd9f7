"""Missing and padding values of stored numpy arrays."""

from __future__ import annotations

import numpy as np

# Fixed values of the stored form.
INT_MISSING, INT_PAD = -1, -2
STR_MISSING, STR_PAD = ".", ""
FLOAT_BITS = {2: (0x7C01, 0x7C02), 4: (0x7F800001, 0x7F800002), 8: (0x7FF0000000000001, 0x7FF0000000000002)}


def _equals(values: np.ndarray, which: int) -> np.ndarray:
    kind = values.dtype.kind
    if kind == "f":
        bits = np.ascontiguousarray(values).view(f"{values.dtype.byteorder}u{values.dtype.itemsize}")
        return bits == FLOAT_BITS[values.dtype.itemsize][which]
    if kind == "i":
        return values == (INT_MISSING, INT_PAD)[which]
    if kind in "OUT":
        return values == (STR_MISSING, STR_PAD)[which]
    if kind == "b":
        return np.zeros(values.shape, bool) if which else ~values
    raise ValueError(f"no missing values are defined for {values.dtype}")


def is_missing(values) -> np.ndarray:
    """Where ``values`` hold the missing mark; an unset flag counts as missing."""
    return _equals(np.asarray(values), 0)


def is_fill(values) -> np.ndarray:
    """Where ``values`` hold the padding mark."""
    return _equals(np.asarray(values), 1)


def trim_fill(values) -> np.ndarray:
    """A vector without the padding at its end."""
    values = np.asarray(values)
    real = np.flatnonzero(~is_fill(values))
    return values[: real[-1] + 1 if len(real) else 0]
