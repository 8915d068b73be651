"""Outer products of ranges, and contiguous sections of them, without materialising either.

Points are numbered from 1 with the first axis fastest. Everything here is arithmetic on the
driver: no answer starts a Spark job, whatever the grid's size. ``to_df`` gives the points of
a section as a DataFrame, decoded from a bounded ``spark.range``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

Number = int | float


class TaskNotPresentError(ValueError):
    """A point that should be re-split isn't on the target grid."""

    def __init__(self, axes: tuple[Axis, ...], task: tuple):
        super().__init__(f"task {task} is not on the grid {axes}")
        self.axes, self.task = axes, task


@dataclass(frozen=True)
class Axis:
    """``length`` values from ``start`` in steps of ``step`` > 0; integers or floats."""

    start: Number
    step: Number
    length: int

    def __post_init__(self) -> None:
        if not self.step > 0:
            raise ValueError(f"an axis rises strictly; its step is {self.step}")
        if self.length < 0:
            raise ValueError("an axis has no negative length")

    @classmethod
    def of(cls, given: Axis | range | tuple[Number, ...] | int) -> Axis:
        """From a range, (first, last), (first, step, last) with both ends included, or a length (1 to n)."""
        if isinstance(given, Axis):
            return given
        if isinstance(given, range):
            return cls(given.start, given.step, len(given))
        if isinstance(given, int):
            return cls(1, 1, given)
        first, step, last = given if len(given) == 3 else (given[0], 1, given[1])
        if not step > 0:
            raise ValueError(f"an axis rises strictly; its step is {step}")
        return cls(first, step, max(0, int((last - first) / step + 1e-9) + 1 if isinstance(step, float) or isinstance(first, float) else (last - first) // step + 1))

    @property
    def is_float(self) -> bool:
        return isinstance(self.start, float) or isinstance(self.step, float)

    def value(self, k: int) -> Number:
        return self.start + self.step * k

    def position(self, value: Number) -> int | None:
        """The 0-based place of a value, or None if the axis doesn't hold it."""
        k = round((value - self.start) / self.step) if self.is_float else (value - self.start) // self.step
        return int(k) if 0 <= k < self.length and self.value(int(k)) == value else None


def grid_axes(axes: Sequence) -> tuple[Axis, ...]:
    """The axes of an outer product; a product of products isn't one."""
    if not axes:
        raise ValueError("a grid needs at least one axis")
    if any(isinstance(a, Section) for a in axes):
        raise ValueError("products can't be nested")
    return tuple(Axis.of(a) for a in axes)


def split_bounds(n: int, np: int, rank: int) -> tuple[int, int]:
    """First and last of ``n`` ordered items that ``rank`` of ``np`` owns; the first n mod np get one more."""
    d, r = divmod(n, np)
    return d * (rank - 1) + min(r, rank - 1) + 1, d * rank + min(r, rank)


def split_rank(n: int, np: int, idx: int) -> int:
    """The rank that owns item ``idx``."""
    d, r = divmod(n, np)
    i = idx - 1
    return i // (d + 1) + 1 if i < r * (d + 1) else r + (i - r * (d + 1)) // d + 1


@dataclass(frozen=True)
class Section:
    """Points ``first`` to ``last`` of the outer product of ``axes``."""

    axes: tuple[Axis, ...]
    first: int
    last: int

    def __post_init__(self) -> None:
        object.__setattr__(self, "axes", grid_axes(self.axes))
        if self.first < 1 or self.last > self.grid_size:
            raise ValueError(f"section {self.first}:{self.last} leaves the grid of {self.grid_size} points")

    @cached_property
    def grid_size(self) -> int:
        return prod(a.length for a in self.axes)

    @cached_property
    def strides(self) -> tuple[int, ...]:
        """Points from one value of an axis to the next."""
        out = [1]
        for a in self.axes[:-1]:
            out.append(out[-1] * a.length)
        return tuple(out)

    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def schema(self) -> StructType:
        """The type of a point: a double for a float axis, else a long."""
        out = StructType()
        for k, a in enumerate(self.axes, 1):
            out.add(f"i{k}", DoubleType() if a.is_float else LongType())
        return out

    def __len__(self) -> int:
        return max(0, self.last - self.first + 1)

    @property
    def is_empty(self) -> bool:
        return self.last < self.first

    def _filled(self) -> None:
        if self.is_empty:
            raise ValueError("the section is empty")

    def _axis(self, dim: int) -> int:
        if not 1 <= dim <= self.ndim:
            raise ValueError(f"dim {dim} isn't between 1 and {self.ndim}")
        self._filled()
        return dim - 1

    # -- decoding ---------------------------------------------------------------------------

    def child_index(self, idx: int) -> tuple[int, ...]:
        """1-based index along each axis of the point numbered ``idx`` in the whole grid."""
        return tuple((idx - 1) // s % a.length + 1 for s, a in zip(self.strides, self.axes, strict=True))

    def child_index_local(self, i: int) -> tuple[int, ...]:
        """The same for the i-th point of the section."""
        return self.child_index(self.first + i - 1)

    def point(self, idx: int) -> tuple[Number, ...]:
        return tuple(a.value(k - 1) for a, k in zip(self.axes, self.child_index(idx), strict=True))

    def __getitem__(self, i: int) -> tuple[Number, ...]:
        """The i-th point, from 1; -1 is the last."""
        at = i if i > 0 else len(self) + 1 + i
        if i == 0 or not 1 <= at <= len(self):
            raise IndexError(f"{i} isn't between 1 and {len(self)}")
        return self.point(self.first + at - 1)

    def __iter__(self) -> Iterator[tuple[Number, ...]]:
        return (self.point(i) for i in range(self.first, self.last + 1))

    @property
    def first_point(self) -> tuple[Number, ...]:
        self._filled()
        return self.point(self.first)

    @property
    def last_point(self) -> tuple[Number, ...]:
        self._filled()
        return self.point(self.last)

    # -- looking up -------------------------------------------------------------------------

    def index_in_grid(self, value: Sequence[Number]) -> int | None:
        """The number of a point in the whole grid, or None if it isn't on it."""
        if len(value) != self.ndim:
            raise ValueError(f"a point has {self.ndim} coordinates")
        idx = 1
        for axis, stride, v in zip(self.axes, self.strides, value, strict=True):
            place = axis.position(v)
            if place is None:
                return None
            idx += place * stride
        return idx

    def __contains__(self, value: Sequence[Number]) -> bool:
        idx = self.index_in_grid(value)
        return idx is not None and self.first <= idx <= self.last

    def local_index(self, value: Sequence[Number]) -> int | None:
        return self.index_in_grid(value) - self.first + 1 if not self.is_empty and value in self else None

    def owner(self, value: Sequence[Number], np: int) -> int | None:
        """The rank of ``np`` that owns a point when the whole grid is split; None off the grid."""
        idx = self.index_in_grid(value)
        if idx is None:
            return None
        if np < 1:
            raise ValueError("at least one rank is needed")
        return split_rank(self.grid_size, np, idx)

    def owner_and_local_index(self, value: Sequence[Number], np: int) -> tuple[int, int] | None:
        rank = self.owner(value, np)
        if rank is None:
            return None
        return rank, self.index_in_grid(value) - split_bounds(self.grid_size, np, rank)[0] + 1

    def recast(self, np: int, axes: Sequence | None = None) -> range | None:
        """The ranks of another split (of ``axes``, by default the same grid) that this section falls on."""
        if self.is_empty:
            return None
        whole = Section(axes if axes is not None else self.axes, 1, 0)
        ends = []
        for task in (self.first_point, self.last_point):
            rank = whole.owner(task, np)
            if rank is None:
                raise TaskNotPresentError(whole.axes, task)
            ends.append(rank)
        return range(ends[0], ends[1] + 1)

    # -- extrema and counts -----------------------------------------------------------------

    def _place(self, idx: int, k: int) -> int:
        """The 0-based place on axis k of a point's number."""
        return (idx - 1) // self.strides[k] % self.axes[k].length

    def _rolls(self, k: int) -> bool:
        """Does a later axis change within the section, so that axis k is covered from end to end?"""
        later = self.strides[k] * self.axes[k].length
        return (self.first - 1) // later != (self.last - 1) // later

    def extrema(self, dim: int = 1) -> tuple[Number, Number]:
        """Smallest and largest value on axis ``dim`` (from 1)."""
        k = self._axis(dim)
        axis = self.axes[k]
        if not self._rolls(k):
            return axis.value(self._place(self.first, k)), axis.value(self._place(self.last, k))
        return axis.value(0), axis.value(axis.length - 1)

    def minimum(self, dim: int = 1) -> Number:
        return self.extrema(dim)[0]

    def maximum(self, dim: int = 1) -> Number:
        return self.extrema(dim)[1]

    def extrema_dims(self) -> tuple[tuple[Number, Number], ...]:
        return tuple(self.extrema(d) for d in range(1, self.ndim + 1))

    def n_distinct(self, dim: int = 1) -> int:
        """How many values of axis ``dim`` occur in the section."""
        k = self._axis(dim)
        n, later = self.axes[k].length, self.strides[k] * self.axes[k].length
        a, b = self._place(self.first, k), self._place(self.last, k)
        wraps = (self.last - 1) // later - (self.first - 1) // later
        return b - a + 1 if wraps == 0 else n if wraps > 1 else min(n, n - a + b + 1)

    def extrema_common_last(self) -> tuple[list[tuple[Number, Number]], list[tuple[Number, Number]]] | None:
        """For each axis but the last: its minimum where the last axis is least, its maximum where that is greatest."""
        if self.is_empty:
            return None
        slab = self.strides[-1]
        low = Section(self.axes, self.first, min(self.last, ((self.first - 1) // slab + 1) * slab))
        high = Section(self.axes, max(self.first, (self.last - 1) // slab * slab + 1), self.last)
        least, most = self.minimum(self.ndim), self.maximum(self.ndim)
        dims = range(1, self.ndim)
        return [(low.minimum(d), least) for d in dims], [(high.maximum(d), most) for d in dims]

    # -- other sections ---------------------------------------------------------------------

    def drop_leading(self) -> Section:
        """The distinct tails of the points, as a section of the grid without its first axis."""
        self._filled()
        if self.ndim == 1:
            raise ValueError("a grid with one axis has no tails")
        n = self.axes[0].length
        return Section(self.axes[1:], (self.first - 1) // n + 1, (self.last - 1) // n + 1)

    def halve(self) -> tuple[Section, Section]:
        """The first half, rounded down, and the rest."""
        middle = self.first + len(self) // 2
        return Section(self.axes, self.first, middle - 1), Section(self.axes, middle, self.last)

    def where(self, lo: Number, hi: Number) -> Section:
        """The points whose last coordinate lies between lo and hi: a contiguous part, found without a scan."""
        axis, slab = self.axes[-1], self.strides[-1]
        places = [k for k in (-(-(lo - axis.start) // axis.step), (hi - axis.start) // axis.step)]
        a, b = max(0, int(places[0])), min(axis.length - 1, int(places[1]))
        first, last = max(self.first, a * slab + 1), min(self.last, (b + 1) * slab)
        return Section(self.axes, first, last) if first <= last else Section(self.axes, self.first, self.first - 1)

    # -- Spark ------------------------------------------------------------------------------

    def to_df(self, spark: SparkSession, names: Sequence[str] | None = None, idx: str | None = None, partitions: int | None = None) -> DataFrame:
        """The points as rows i1 ... iN (or ``names``), with their number in the grid if ``idx`` is given."""
        from gridloom.functions.exprs import decode

        rows = spark.range(self.first, self.last + 1, 1, partitions) if partitions else spark.range(self.first, self.last + 1)
        names = names or [f"i{k + 1}" for k in range(self.ndim)]
        points = [c.alias(n) for c, n in zip(decode(F.col("id"), self.axes), names, strict=True)]
        return rows.select(*([F.col("id").alias(idx)] if idx else []), *points)

    def __repr__(self) -> str:
        if self.is_empty:
            return f"0-element {type(self).__name__}"
        if len(self) == 1:
            return f"1-element {type(self).__name__} [{self.first_point}]"
        if len(self) == 2:
            return f"2-element {type(self).__name__} [{self.first_point}, {self.last_point}]"
        return f"{len(self)}-element {type(self).__name__} [{self.first_point}, ... , {self.last_point}]"


@dataclass(frozen=True, repr=False)
class Split(Section):
    """The section that ``rank`` of ``np`` owns; empty if there are fewer points than ranks."""

    np: int = 1
    rank: int = 1


def grid(*axes) -> Section:
    """The whole outer product."""
    made = grid_axes(axes)
    return Section(made, 1, prod(a.length for a in made))


def split(axes: Sequence, np: int, rank: int) -> Split:
    """The part of the outer product that ``rank`` of ``np`` owns."""
    if not 1 <= rank <= np:
        raise ValueError(f"rank {rank} isn't between 1 and {np}")
    made = grid_axes(axes)
    first, last = split_bounds(prod(a.length for a in made), np, rank)
    return Split(made, first, last, np, rank)


def splits(axes: Sequence, np: int) -> list[Split]:
    return [split(axes, np, p) for p in range(1, np + 1)]
