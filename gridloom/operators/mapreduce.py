"""Map-reduce over ordered rows and over sections of grids."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import rows as R
from gridloom.operators.arrays import Box, as_fold
from gridloom.operators.grid import Split, grid_axes, split, splits
from gridloom.operators.reducers import Aggregate, Collect, Concat, Fold, MergeMaps, Reducer
from gridloom.plans.storage import checkpointed

#: Partial results that one task of a merge round folds.
FAN_IN = 16


class EmptyInput(ValueError):
    """There is nothing to reduce and no initial value."""


def aggregate(df: DataFrame, value: Column, op: Aggregate, init: Any = None, name: str = "value") -> DataFrame:
    """One row: all values reduced by a built-in aggregate, with ``init`` taken in once.

    A single pass with partial aggregates in each task. An empty input gives ``init``, or null if there is none; :func:`map_reduce` raises for the latter.
    """
    found = op.column(value)
    if init is not None:
        found = F.coalesce(op.combine(F.lit(init), found), F.lit(init))
    return df.agg(found.alias(name))


def map_reduce(df: DataFrame, value: Column, op: Reducer, order_by: Sequence[str | Column] = (), init: Any = None, name: str = "value", key: Column | None = None) -> DataFrame:
    """Apply an expression to each row and reduce. A Python function of a row is given as an Arrow function of columns
    (``F.arrow_udf``), which gets batches; plain expressions stay in the JVM.

    Aggregates need no order; texts, lists and maps are collected with their order key, so partial results may come in any
    order; a Fold runs Python over the sorted rows. An empty input without ``init`` raises.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not isinstance(op, Aggregate) and not op.commutative and not order:
        raise ValueError("an operator that isn't commutative needs an order")
    if isinstance(op, Aggregate):
        if init is None and df.isEmpty():
            raise EmptyInput("reduce over an empty input without an initial value")
        return aggregate(df, value, op, init, name)
    if isinstance(op, MergeMaps):
        if key is None:
            raise ValueError("maps are merged by key")
        pick = F.min_by if op.flipped else F.max_by
        return df.groupBy(key.alias("key")).agg(pick(value, F.struct(*order)).alias(name))
    if isinstance(op, (Concat, Collect)):
        items = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("k"), value.alias("v"))), asc=not op.flipped)
        parts = F.transform(items, lambda x: x["v"])
        return df.agg((F.array_join(parts, op.separator) if isinstance(op, Concat) else parts).alias(name))
    if not isinstance(op, Fold):
        raise TypeError(f"{op} isn't a reducer of rows")
    return fold(df, value, op, order, init, name)


def _fold_rows(op: Fold, init: bytes | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold the values of a partition in their order to one pickled value."""

    def run(batches):
        none = object()
        now, first = none, None
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = pickle.loads(v) if isinstance(v, bytes) and batch.schema.names[1] == "part" else v
                first = k if first is None else first
                now = v if now is none else op(now, v)
        if now is not none:
            yield pa.RecordBatch.from_pydict({"k": pa.array([first], pa.int64()), "part": pa.array([pickle.dumps(now)], pa.binary())})

    return run


def fold(df: DataFrame, value: Column, op: Fold, order: Sequence[Column], init: Any = None, name: str = "value") -> DataFrame:
    """(value binary): the pickled result of an ordered fold; see :func:`fold_value`.

    Each task folds its range of the order, then rounds of at most FAN_IN neighbours are
    folded until one is left, so no task sees more than that many partial results.
    """
    rows = R.number_rows(df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v")), [f"o{i}" for i in range(len(order))], "k")
    if not rows.count:
        if init is None:
            raise EmptyInput("reduce over an empty input without an initial value")
        return df.sparkSession.createDataFrame([(bytearray(pickle.dumps(init)),)], f"{name} binary")
    run = _fold_rows(op)
    parts = checkpointed(rows.df.select("k", "v").mapInArrow(run, "k long, part binary"))
    left = parts.count()
    while left > 1:
        numbered = R.number_rows(parts, ["k"], "n").df
        group = F.floor((F.col("n") - 1) / FAN_IN)

        def merge(key, table, run=run):
            batch = table.sort_by("k").select(["k", "part"]).combine_chunks().to_batches()
            return pa.Table.from_batches(list(run(iter(batch))))

        parts = checkpointed(numbered.groupBy(group.alias("g")).applyInArrow(lambda table: merge(None, table.select(["k", "part"])), "k long, part binary"))
        left = -(-left // FAN_IN)
    if init is not None:
        def begin(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(op(init, pickle.loads(x))) for x in batch.column(1).to_pylist()], pa.binary())})

        parts = parts.mapInArrow(begin, "part binary")
    return parts.select(F.col("part").alias(name))


def fold_value(df: DataFrame) -> Any:
    """The Python value of a fold's only row."""
    return pickle.loads(bytes(df.first()[0]))


def map_batch(df: DataFrame, keys: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    """An ordered map: a projection that keeps the order key; sort only where the order is shown."""
    return df.select(*keys, value.alias(name))


# -- sections -----------------------------------------------------------------------------------


def section_rows(df: DataFrame, order_by: Sequence[str | Column], np: int, rank: str = "r", **aggregates: Column) -> DataFrame:
    """One row a rank: the aggregates of the rows that each of ``np`` ranks owns."""
    made = R.with_rank(df, order_by, np, rank)
    return made.groupBy(rank).agg(*[c.alias(n) for n, c in aggregates.items()])


def section_table(spark: SparkSession, axes: Sequence, np: int, **answers: Callable[[Split], Any]) -> DataFrame:
    """One row a rank of answers that sections give in closed form, made on the driver."""
    return spark.createDataFrame([{"rank": s.rank, **{n: f(s) for n, f in answers.items()}} for s in splits(axes, np)])


def _bounded_ranks(axes: Sequence, np: int) -> tuple[tuple, int]:
    made = grid_axes(axes)
    n = math.prod(a.length for a in made)
    if np < 1 or n < 1:
        raise ValueError("a map over sections needs at least one rank and one point")
    return made, min(np, n)


def map_sections(spark: SparkSession, axes: Sequence, np: int, f: Callable[[Split], Any]) -> DataFrame:
    """(rank, part): ``f`` called once for each rank that owns points, with the whole section; values are pickled.

    At most one rank a point is used. Each rank is a partition. A task may be tried again, so ``f``
    must not have effects that may not happen twice; any error fails the whole call.
    """
    made, np = _bounded_ranks(axes, np)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                value = f(split(made, np, k + 1))
                yield pa.RecordBatch.from_pydict({"rank": pa.array([k + 1], pa.int64()), "part": pa.array([pickle.dumps(value)], pa.binary())})

    return spark.range(0, np, 1, np).mapInArrow(run, "rank long, part binary")


#: Bytes of partial results that one task of a merge round holds, about.
MERGE_BYTES = 256 << 20


def map_reduce_sections(spark: SparkSession, axes: Sequence, np: int, f: Callable[[Split], Any], op: Reducer, init: Any = None) -> Any:
    """Reduce what ``f`` gives for each section, in rank order, with ``init`` before the first rank.

    ``op`` may be any reducer: numbers and numpy arrays of any dimension are reduced by aggregates and
    :class:`Elementwise` (arrays of different shape raise), arrays with bounds (:class:`gridloom.operators.arrays.Box`)
    by :class:`Stack`, which gives the array of the whole box with 0 in gaps. A task folds the
    sections of its ranks one after another, so one partial result a task is moved; a merge takes
    as many of them as fit ``MERGE_BYTES``, at least 2 and at most ``FAN_IN``. Only the result comes to the driver.
    """
    do = as_fold(op)
    made, ranks = _bounded_ranks(axes, np)
    tasks = min(ranks, max(1, spark.sparkContext.defaultParallelism))

    def local(batches):
        none = object()
        now = none
        for batch in batches:
            for k in batch.column(0).to_pylist():
                value = f(split(made, ranks, k + 1))
                now = value if now is none else do(now, value)
        if now is not none:
            yield pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int64()), "part": pa.array([pickle.dumps(now, 5)], pa.binary())})

    def merge(table):
        table = table.sort_by("place")
        now = pickle.loads(table.column("part")[0].as_buffer())
        for k in range(1, len(table)):
            now = do(now, pickle.loads(table.column("part")[k].as_buffer()))
        return pa.table({"place": pa.array([table.column("place")[0].as_py() // fan], pa.int64()), "part": pa.array([pickle.dumps(now, 5)], pa.binary())})

    # Places of tasks follow each other without gaps, and so do those of their merged neighbours.
    parts = checkpointed(spark.range(0, ranks, 1, tasks).mapInArrow(local, "place long, part binary"))
    left, size = parts.agg(F.count("*"), F.max(F.octet_length("part"))).first()
    fan = max(2, min(FAN_IN, MERGE_BYTES // max(1, size)))
    while left > 1:
        parts = checkpointed(parts.groupBy(F.floor(F.col("place") / fan).alias("g")).applyInArrow(merge, "place long, part binary"))
        left = -(-left // fan)
    value = pickle.loads(parts.select("part").toArrow().column(0)[0].as_buffer())
    value = value if init is None else do(init, value)
    return value.filled() if isinstance(value, Box) else value


def map_batch_sections(spark: SparkSession, axes: Sequence, np: int, f: Callable[[Split], Any]) -> list[Any]:
    """What ``f`` gives for each rank, in rank order."""
    return [pickle.loads(bytes(r.part)) for r in map_sections(spark, axes, np, f).orderBy("rank").toLocalIterator()]


def serial_map_reduce(values: Sequence[Any], f: Callable[..., Any], op: Callable[[Any, Any], Any], init: Any = None) -> Any:
    """The same on the driver, for a single rank."""
    made = [f(*v) if isinstance(v, tuple) else f(v) for v in values]
    if not made and init is None:
        raise EmptyInput("reduce over an empty input without an initial value")
    return reduce(op, made) if init is None else reduce(op, made, init)
