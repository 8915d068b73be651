"""Reducers as functions of two numpy arrays of any dimension, for values that Python functions make."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np

from gridloom.operators.reducers import Aggregate, Collect, Concat, DimensionMismatch, Elementwise, Fold, MergeMaps, Reducer, Stack

_UFUNCS = {"sum": np.add, "product": np.multiply, "min": np.minimum, "max": np.maximum}


@dataclass
class Box:
    """An array with the first index of each axis, and which of its cells hold data (all by default)."""

    lo: tuple[int, ...]
    values: np.ndarray
    covered: np.ndarray | None = None

    def filled(self) -> np.ndarray:
        """The values with 0 in each gap."""
        return self.values if self.covered is None else np.where(self.covered, self.values, 0)


def elementwise(op: Aggregate, a: Any, b: Any) -> np.ndarray:
    """One operation for each cell; arrays of different shape raise. An own float or int array is reused for the result."""
    a, b = np.asarray(a), np.asarray(b)
    if a.shape != b.shape:
        raise DimensionMismatch(f"arrays of shape {a.shape} and {b.shape}")
    own = a.flags.writeable and a.flags.owndata and np.can_cast(b.dtype, a.dtype, "safe")
    return _UFUNCS[op.name](a, b, out=a if own else None)


def stacked(op: Aggregate, dims: Sequence[int] | None, a: Box, b: Box) -> Box:
    """Two boxes laid over each other in the box around both; cells of both are reduced, gaps stay gaps."""
    n = a.values.ndim
    if b.values.ndim != n or len(a.lo) != n or len(b.lo) != n:
        raise DimensionMismatch("boxes of different dimension")
    ends = [[lo + size for lo, size in zip(x.lo, x.values.shape, strict=True)] for x in (a, b)]
    for k in range(n):
        if dims is not None and k + 1 not in dims and (a.lo[k], ends[0][k]) != (b.lo[k], ends[1][k]):
            raise DimensionMismatch(f"arrays differ on axis {k + 1}")
    lo = tuple(map(min, a.lo, b.lo))
    shape = [max(x, y) - z for x, y, z in zip(*ends, lo, strict=True)]
    values, covered = np.zeros(shape, np.result_type(a.values, b.values)), np.zeros(shape, bool)
    for x in (a, b):
        at = tuple(slice(p - q, p - q + size) for p, q, size in zip(x.lo, lo, x.values.shape, strict=True))
        mine = np.ones(x.values.shape, bool) if x.covered is None else x.covered
        both = mine & covered[at]
        values[at] = np.where(both, _UFUNCS[op.name](values[at], x.values), np.where(mine, x.values, values[at]))
        covered[at] |= mine
    return Box(lo, values, None if covered.all() else covered)


def as_fold(op: Reducer) -> Fold:
    """The reducer as a fold of Python values: numbers, arrays, boxes, lists, texts or dicts."""
    if isinstance(op, Fold):
        return op
    if isinstance(op, Elementwise):
        f: Callable[[Any, Any], Any] = lambda a, b: elementwise(op.op, a, b)
    elif isinstance(op, Stack):
        f = lambda a, b: stacked(op.op, op.dims, a, b)
    elif isinstance(op, Aggregate):
        f = _UFUNCS[op.name]
    elif isinstance(op, Concat):
        f = lambda a, b: f"{a}{op.separator}{b}" if isinstance(a, str) else np.concatenate([a, b], axis=-1)
    elif isinstance(op, Collect):
        f = lambda a, b: [*a, *b]
    elif isinstance(op, MergeMaps):
        f = lambda a, b: {**a, **b}
    else:
        raise TypeError(f"{op} isn't a reducer of Python values")
    return Fold(function=f, flipped=op.flipped, commutative=op.commutative)
