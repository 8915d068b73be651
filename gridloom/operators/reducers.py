"""Reduction operators. Each says how Catalyst can do it, or that it must be folded in rank order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reducer:
    """An associative operator; ``commutative`` allows partial results in any order."""

    commutative: bool = False
    flipped: bool = False

    def flip(self) -> Reducer:
        """The operator with its arguments swapped; twice gives the operator back."""
        return replace(self, flipped=not self.flipped)


def Commutative(op: Reducer) -> Reducer:  # noqa: N802
    """Tag an operator as commutative. The claim isn't checked."""
    return replace(op, commutative=True)


def Flip(op: Reducer) -> Reducer:  # noqa: N802
    return op.flip()


@dataclass(frozen=True)
class Aggregate(Reducer):
    """An operator with an aggregate of its own: partial and final aggregation, no rank needed."""

    name: str = "sum"
    commutative: bool = True

    def column(self, value: Column) -> Column:
        return {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[self.name](value)

    def combine(self, a: Column, b: Column) -> Column:
        return {"sum": lambda: a + b, "product": lambda: a * b, "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}[self.name]()


Sum, Product, Min, Max = Aggregate(name="sum"), Aggregate(name="product"), Aggregate(name="min"), Aggregate(name="max")


@dataclass(frozen=True)
class Concat(Reducer):
    """Texts joined in order; a value for the whole result must fit a row."""

    separator: str = ""


@dataclass(frozen=True)
class Collect(Reducer):
    """Values appended in order to an array, which must fit a row."""


@dataclass(frozen=True)
class MergeMaps(Reducer):
    """Key-value pairs merged so that the last value of each key wins (flipped: the first)."""


@dataclass(frozen=True)
class Fold(Reducer):
    """Any Python function of two values, folded in order: within partitions, then over partial results."""

    function: Callable[[Any, Any], Any] = lambda a, b: a + b

    def __call__(self, a: Any, b: Any) -> Any:
        return self.function(b, a) if self.flipped else self.function(a, b)


class DimensionMismatch(ValueError):
    """Arrays whose axes don't go together."""


@dataclass(frozen=True)
class Elementwise(Reducer):
    """One aggregate for each position of equally long arrays."""

    op: Aggregate = Sum
    commutative: bool = True

    def reduce(self, df: DataFrame, array: str | Column, position: str = "pos", value: str = "v") -> DataFrame:
        """(pos, v): arrays are spread into rows and aggregated by position, with partial sums in each task.

        Arrays of different length, without elements or with null ones raise when the result is read.
        """
        v = F.col("__v")
        return self._spread(df, array, position).groupBy(position).agg(_checked(self.op.column(v)).alias(value))

    def reduce_many(self, df: DataFrame, array: str | Column, ops: dict[str, Aggregate], position: str = "pos") -> DataFrame:
        """(pos, a column an operator), in one pass; see :meth:`reduce`."""
        v = F.col("__v").cast("double")
        return self._spread(df, array, position).groupBy(position).agg(*[_checked(op.column(v)).alias(n) for n, op in ops.items()])

    @staticmethod
    def _spread(df: DataFrame, array: str | Column, position: str) -> DataFrame:
        a = F.col(array) if isinstance(array, str) else array
        whole = F.when(F.size(a) > 0, a).otherwise(F.raise_error(F.lit("an array without elements")))
        rows = df.select(whole.alias("__a")).select(F.size("__a").alias("__n"), F.posexplode("__a").alias(position, "__v"))
        return rows.withColumn(position, F.col(position).cast("long"))

    @staticmethod
    def check(df: DataFrame, array: str) -> None:
        """Raise unless all arrays have the same length and no null element."""
        size = F.size(array)
        lo, hi, bad = df.agg(F.min(size), F.max(size), F.max(F.exists(array, lambda x: x.isNull()).cast("int"))).first()
        if lo != hi or bad or lo == -1:
            raise DimensionMismatch("arrays differ in length or hold nulls")


def _checked(found: Column) -> Column:
    """The aggregate of a position, if all arrays are equally long and hold a value there."""
    fits = (F.min("__n") == F.max("__n")) & (F.count("__v") == F.count("__n"))
    return F.when(fits, found).otherwise(F.raise_error(F.lit("arrays differ in length or hold nulls")))


def zip_arrays(op: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """Elementwise combination of two array columns; an array of length 1 is stretched to the other's.

    Lengths that don't go together raise an error, since zip_with would pad with nulls.
    """
    n, m = F.size(a), F.size(b)
    wide = lambda x, own, other: F.when(own == 1, F.array_repeat(F.element_at(x, 1), other)).otherwise(x)
    fits = (n == m) | (n == 1) | (m == 1)
    return F.when(fits, F.zip_with(wide(a, n, m), wide(b, m, n), op)).otherwise(F.raise_error(F.lit("arrays differ in length")))


@dataclass(frozen=True)
class Stack(Reducer):
    """Arrays with bounds, laid over each other: cells in several are reduced, gaps in the bounding box are 0.

    A gap isn't data: it never takes part in ``op``. Axes that aren't among ``dims`` (all by
    default) must have the same bounds in all arrays.
    """

    op: Aggregate = Sum
    dims: tuple[int, ...] | None = None
    commutative: bool = True

    def reduce(self, cells: DataFrame, axes: Sequence[str], value: str = "v", key: str | None = None) -> DataFrame:
        """Cells (axes..., v) of all arrays to the cells of the whole box; ``key`` names the array, for the check of bounds."""
        dims = self.dims or tuple(range(1, len(axes) + 1))
        if any(not 1 <= d <= len(axes) for d in dims):
            raise ValueError(f"dims lie between 1 and {len(axes)}")
        fixed = [a for k, a in enumerate(axes, 1) if k not in dims]
        if fixed and key is None:
            raise ValueError("name the array's key, so that its other axes can be compared")
        if fixed:
            each = cells.groupBy(key).agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(fixed) for n, f in (("lo", F.min), ("hi", F.max))])
            if each.drop(key).distinct().count() > 1:
                raise DimensionMismatch(f"arrays differ on {', '.join(fixed)}")
        found = cells.groupBy(*axes).agg(self.op.column(F.col(value)).alias(value))
        bounds = cells.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
        if bounds[0] is None:
            return found
        from gridloom.operators.grid import grid

        box = grid(*[(lo, hi) for lo, hi in zip(bounds[::2], bounds[1::2], strict=True)]).to_df(cells.sparkSession, list(axes))
        return box.join(found, list(axes), "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def stack_arrays(df: DataFrame, lo: Column, array: Column, op: Aggregate = Sum, idx: str = "idx", value: str = "v") -> DataFrame:
    """One-dimensional stacking of arrays that start at ``lo``."""
    cells = df.select(lo.cast("long").alias("__lo"), F.posexplode(array).alias("__p", value)).select((F.col("__lo") + F.col("__p")).alias(idx), F.col(value).cast("double").alias(value))
    return Stack(op=op).reduce(cells, [idx], value)
