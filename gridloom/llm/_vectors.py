"""Blocks of queries against all rows: what the two vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task searches at once, and queries sent to the executors at once.
CHUNK, QUERIES = 1 << 15, 1 << 13


def vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, ...]:
    """Ids and vectors of the rows that take part: id known, ``dims`` finite components, not all zero.

    Further columns of the batch follow: numbers as they are, binary values of one length as rows of bytes.
    """
    ids, lists = batch.column("id"), batch.column("v")
    size = lists.value_lengths().fill_null(-1).to_numpy()
    fit = (size == dims) & ids.is_valid().to_numpy(zero_copy_only=False)
    lists = lists.filter(pa.array(fit))
    flat = lists.flatten()
    value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(value).all(axis=1) & (value != 0).any(axis=1)
    rest = [_plain(batch.column(k).filter(pa.array(fit)).filter(pa.array(good))) for k in range(2, batch.num_columns)]
    return ids.filter(pa.array(fit)).to_numpy()[good], value[good], *rest


def _plain(column: pa.Array) -> np.ndarray:
    if column.type != pa.binary():
        return column.to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return raw.reshape(len(column), len(raw) // max(1, len(column)))


def chunks(batches: Iterator[pa.RecordBatch], dims: int, rows: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """What :func:`vectors` gives, in chunks of at most ``rows``, each sorted by id."""
    held, n = [], 0

    def close():
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(x[order] for x in columns)

    for batch in batches:
        columns = vectors(batch, dims)
        for a in range(0, len(columns[0]), rows):
            part = [x[a : a + rows] for x in columns]
            if n + len(part[0]) > rows:
                yield close()
                held, n = [], 0
            held.append(part)
            n += len(part[0])
    if n:
        yield close()


def search(base: DataFrame, queries: DataFrame, dims: int, k: int, score: str, run: Callable[[np.ndarray, np.ndarray], Callable], id_col: str, vector_col: str, block: int = QUERIES, stored: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all rows, by rising score, then id.

    Queries are sent in blocks of at most ``block`` vectors, a fixed number of bytes; each block is one pass over the base.
    ``run(ids, vectors)`` of a block gives the function that maps a chunk and each query's k-th score so
    far to (query's place, id, score) of rows that may be among its best; the chunk also has the base's
    ``stored`` columns. A task keeps the k best of each query, so at most tasks * queries * k rows leave the tasks.
    """
    spark = base.sparkSession
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *stored)
    schema = f"query_id long, vec_id long, score {score}"
    # A row that takes no part must not hide another of the same id.
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = (F.size(vector_col) == dims) & F.forall(vector_col, lambda x: finite(x.cast("double"))) & F.exists(vector_col, lambda x: x != 0)
    asked = queries.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(good).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("v"))
    parts, held = [], []

    def add():
        block_of = pa.RecordBatch.from_arrays([pa.array([r.id for r in held], pa.int64()), pa.array([r.v for r in held], pa.list_(pa.float64()))], ["id", "v"])
        ids, value = vectors(block_of, dims)
        if len(ids):
            sent = spark.sparkContext.broadcast((ids, value))

            def best(batches):
                own, asked = sent.value
                find, best = run(own, asked), Best(len(own), k)
                for chunk in chunks(batches, dims):
                    best.add(*find(*chunk, best.bound))
                for a in range(0, len(best.query), 1 << 16):
                    q, i, s = (x[a : a + (1 << 16)] for x in (best.query, best.ids, best.score))
                    yield pa.RecordBatch.from_arrays([pa.array(own[q], pa.int64()), pa.array(i, pa.int64()), pa.array(s)], ["query_id", "vec_id", "score"])

            parts.append(rows.mapInArrow(best, schema))
        held.clear()

    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == block:
            add()
    add()
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best rows of each query so far, by (score, id), and the score that a further row may have at most."""

    def __init__(self, queries: int, k: int):
        self.k, self.bound = k, np.full(queries, np.inf)
        self.query, self.ids, self.score = (np.zeros(0, np.int64),) * 3

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, i, s = (np.concatenate([a, b]) if len(a) else b for a, b in ((self.query, query), (self.ids, ids), (self.score, score)))
        keep = first_k(q, i, s, self.k)
        self.query, self.ids, self.score = q[keep], i[keep], s[keep]
        last = np.flatnonzero(np.append(self.query[1:] != self.query[:-1], True)) if len(keep) else keep
        full = last[np.bincount(self.query, minlength=len(self.bound))[self.query[last]] == self.k]
        self.bound[self.query[full]] = self.score[full]


def first_k(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k first rows by (score, id)."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    number = np.arange(len(q)) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(q))))
    return order[number < k]


def with_copies(query: np.ndarray, spot: np.ndarray, score: np.ndarray, firsts: np.ndarray, count: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int):
    """Replace each hit on a distinct value by its k + 1 smallest ids, less the query's own."""
    each = np.minimum(count[spot], k + 1)
    at = np.repeat(firsts[spot], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    q, i, s = np.repeat(query, each), ids[at], np.repeat(score, each)
    other = query_ids[q] != i
    q, i, s = q[other], i[other], s[other]
    keep = first_k(q, i, s, k)
    return q[keep], i[keep], s[keep]
