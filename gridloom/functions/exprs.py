"""Column expressions for grids and balanced splits; they stay within whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.grid import Axis, Section



def child_index(idx: Column, axes: Sequence[Axis]) -> list[Column]:
    """0-based index along each axis of a point's number (from 1)."""
    out, stride = [], 1
    for k, a in enumerate(axes):
        at = idx - 1 if stride == 1 else F.call_function("div", idx - 1, F.lit(stride).cast("long"))
        out.append(at if k == len(axes) - 1 else at % F.lit(a.length).cast("long"))
        stride *= a.length
    return out


def decode(idx: Column, axes: Sequence[Axis]) -> list[Column]:
    """The point with this number: one column an axis."""
    return [F.lit(a.start) + F.lit(a.step) * k if a.is_float else F.lit(a.start).cast("long") + F.lit(a.step).cast("long") * k for a, k in zip(axes, child_index(idx, axes), strict=True)]


def linear_index(values: Sequence[Column], axes: Sequence[Axis]) -> Column:
    """A point's number, or null if a coordinate is null or off its axis."""
    places, on, stride = [], [], 1
    for v, a in zip(values, axes, strict=True):
        if a.is_float:
            k = F.round((v - F.lit(a.start)) / F.lit(a.step)).cast("long")
            on.append((F.lit(a.start) + F.lit(a.step) * k) == v)
        else:
            v = v.cast("long")
            k = F.call_function("div", v - F.lit(a.start), F.lit(a.step).cast("long"))
            on.append((v - F.lit(a.start)) % F.lit(a.step) == 0)
        on.append((v >= F.lit(a.start)) & (v <= F.lit(a.value(a.length - 1))))
        places.append(k * F.lit(stride).cast("long"))
        stride *= a.length
    return F.when(reduce(and_, on), 1 + sum(places[1:], places[0]))


def rank_of(idx: Column, n: int, np: int) -> Column:
    """The rank of ``np`` that owns item ``idx`` of n."""
    if np < 1:
        raise ValueError("at least one rank is needed")
    d, r = divmod(n, np)
    i, div = idx - 1, lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    low = div(i, d + 1) + 1
    return low if not d else F.when(i < F.lit(r * (d + 1)), low).otherwise(div(i - r * (d + 1), d) + 1 + r)


def local_index(idx: Column, n: int, np: int) -> Column:
    """The place of item ``idx`` within its rank, from 1."""
    d, r = divmod(n, np)
    before = rank_of(idx, n, np) - 1
    return idx - (before * d + F.least(F.lit(r).cast("long"), before))


def in_section(idx: Column, section: Section) -> Column:
    """Whether a point's number lies in the section; null for a null number."""
    return idx.between(section.first, section.last)
