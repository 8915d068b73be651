"""Balanced, contiguous splits of the rows of any DataFrame that has a total order.

Numbers come from one range-partitioned sort and the partitions' counts, so no step puts all rows
into one task. The sorted rows are checkpointed, since the bounds of a range partitioning are
sampled anew in each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import local_index, rank_of
from gridloom.operators.grid import split_bounds
from gridloom.plans.storage import checkpointed

_LOW = (1 << 33) - 1
#: Offsets up to this many are literals of an expression; more are joined.
_IN_EXPRESSION = 500


class Numbered:
    """Rows with their number (from 1, column ``idx``) in a total order, and how many there are."""

    def __init__(self, df: DataFrame, count: int, idx: str):
        self.df, self.count, self.idx = df, count, idx


def number_rows(df: DataFrame, order_by: Sequence[str | Column], idx: str = "idx") -> Numbered:
    """Number the rows in the given order. Ties get different numbers in no promised order."""
    own = F.monotonically_increasing_id()
    rows = checkpointed(df.orderBy(*order_by).withColumn("__row", own))
    part = F.shiftrightunsigned("__row", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for p, n in counts:  # one entry a partition
        offsets.append((p, total))
        total += n
    if len(offsets) <= 1:
        before: Column = F.lit(0).cast("long")
    elif len(offsets) <= _IN_EXPRESSION:
        before = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair]), part)
    else:  # one row a partition, so its size is bounded by the number of partitions
        table = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
        rows, before = rows.join(F.broadcast(table), part == F.col("__part")).drop("__part"), F.col("__before")
    made = rows.withColumn(idx, before + F.col("__row").bitwiseAND(_LOW) + 1).drop("__row", "__before")
    return Numbered(made, total, idx)


def with_rank(df: DataFrame, order_by: Sequence[str | Column], np: int, rank: str = "r", local: str | None = None) -> DataFrame:
    """Each row's rank of ``np``, as ``NTILE(np)`` gives it, and its place in that rank if ``local`` is given."""
    if np < 1:
        raise ValueError("at least one rank is needed")
    rows = number_rows(df, order_by, "__idx")
    made = rows.df.withColumn(rank, rank_of(F.col("__idx"), rows.count, np))
    if local:
        made = made.withColumn(local, local_index(F.col("__idx"), rows.count, np))
    return made.drop("__idx")


def with_ranks(df: DataFrame, order_by: Sequence[str | Column], nps: dict[str, int]) -> DataFrame:
    """The ranks of several splits of the same rows, which are sorted once."""
    rows = number_rows(df, order_by, "__idx")
    return rows.df.withColumns({name: rank_of(F.col("__idx"), rows.count, np) for name, np in nps.items()}).drop("__idx")


def recast_ranks(df: DataFrame, order_by: Sequence[str | Column], np: int, np_new: int) -> DataFrame:
    """For each rank of ``np`` the first and last rank of ``np_new`` on which its rows fall."""
    both = with_ranks(df, order_by, {"rank": np, "new": np_new})
    return both.groupBy("rank").agg(F.min("new").alias("lo"), F.max("new").alias("hi"))


def slice_rows(df: DataFrame, order_by: Sequence[str | Column], skip: int, take: int, idx: str = "idx") -> DataFrame:
    """``take`` rows after the first ``skip``, with their numbers."""
    if skip < 0 or take < 0:
        raise ValueError("skip and take aren't negative")
    rows = number_rows(df, order_by, idx)
    return rows.df.filter(F.col(idx).between(skip + 1, skip + take))


def split_rows(df: DataFrame, order_by: Sequence[str | Column], np: int, rank: int) -> DataFrame:
    """The rows that ``rank`` of ``np`` owns."""
    if not 1 <= rank <= np:
        raise ValueError(f"rank {rank} isn't between 1 and {np}")
    rows = number_rows(df, order_by, "__idx")
    first, last = split_bounds(rows.count, np, rank)
    return rows.df.filter(F.col("__idx").between(first, last)).drop("__idx")


def halve_rows(df: DataFrame, order_by: Sequence[str | Column], side: str = "side") -> DataFrame:
    """'L' for the first half, rounded down, 'R' for the rest."""
    rows = number_rows(df, order_by, "__idx")
    return rows.df.withColumn(side, F.when(F.col("__idx") <= rows.count // 2, "L").otherwise("R")).drop("__idx")


def zip_rows(frames: Sequence[tuple[DataFrame, Sequence[str | Column]]], idx: str = "idx") -> DataFrame:
    """Rows of equal number side by side, up to the shortest frame. Column names must differ."""
    names = [c for df, _ in frames for c in df.columns]
    if not frames or len(set(names)) < len(names):
        raise ValueError("zip takes at least one frame, and frames with different column names")
    made = [number_rows(df, order, idx).df for df, order in frames]
    out = made[0]
    for other in made[1:]:
        out = out.join(other, idx)
    return out


def drop_leading(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The distinct tails of rows."""
    if not keep:
        raise ValueError("a grid with one axis has no tails")
    return df.select(*keep).distinct()
