"""Approximate nearest neighbours by additive quantisation, reranked exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gridloom.llm import _vectors
from gridloom.llm._base import written

#: Codebooks and their words; vectors that train them at most; vectors kept in the beam.
BOOKS, WORDS, MOST_TRAINING, BEAM = 16, 256, 20_000, 4
#: Distinct rows of a chunk (of at most 32,768) that are reranked for each query.
RERANK = 512


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        some = count > 0
        centres[some] = total[some] / count[some, None]
    return centres


def encode(rows: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search: the best ``beam`` sums of words so far are carried on."""
    m, k, d = books.shape
    out = np.zeros((len(rows), m), np.uint8)
    for a in range(0, len(rows), 2048):
        x = rows[a : a + 2048].astype(np.float32)
        rest, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.int64)
        cost = (x**2).sum(1)[:, None]
        for book in books:
            total = cost[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
            wide = total.reshape(len(x), -1)
            b = min(beam, wide.shape[1])
            best = np.argpartition(wide, b - 1, axis=1)[:, :b]
            cost = np.take_along_axis(wide, best, axis=1)
            parent, word = best // k, best % k
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
        out[a : a + 2048] = np.take_along_axis(codes, cost.argmin(1)[:, None, None], axis=1)[:, 0, :]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def train(rows: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11) -> np.ndarray:
    """Full-dimensional codebooks: k-means of the rows, then of what is left of them, and so on."""
    rest, rng = rows.astype(np.float32), np.random.default_rng(seed)
    words, made = max(1, min(words, len(rest))), []
    for _ in range(books):
        book = _kmeans(rest, words, rng)
        rest = rest - book[np.argmin((book**2).sum(1) - 2 * rest @ book.T, axis=1)]
        made.append(book)
    return np.stack(made)


def _distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, the number of the value of each row, and counts of the distinct vectors."""
    raw = np.ascontiguousarray(value + 0.0).view(np.dtype((np.void, value.shape[1] * 8))).reshape(-1)
    return np.unique(raw, return_index=True, return_inverse=True, return_counts=True)[1:]


def _searcher(books: np.ndarray, k: int, rerank: int):
    def run(query_ids: np.ndarray, asked: np.ndarray):
        def find(ids: np.ndarray, value: np.ndarray, code: np.ndarray, norm: np.ndarray, bound: np.ndarray):
            where, inverse, count = _distinct(value)
            order = np.lexsort((ids, inverse))
            firsts = np.cumsum(count) - count
            rows, codes, norms = value[where], code[where], norm[where]
            most, parts = min(rerank, len(rows)), []
            for a in range(0, len(asked), 128):
                q = asked[a : a + 128]
                table = np.einsum("qd,mkd->mqk", q.astype(np.float32), books)
                score = np.broadcast_to(norms, (len(q), len(rows))).astype(np.float32)
                for m in range(len(books)):
                    score -= 2 * table[m][:, codes[:, m]]
                best = np.argpartition(score, most - 1, axis=1)[:, :most]
                who, spot = np.repeat(np.arange(len(q)), most), best.reshape(-1)
                exact = np.sqrt(((q[who] - rows[spot]) ** 2).sum(1))
                near = exact <= bound[a + who]
                who, spot, exact = who[near], spot[near], exact[near]
                parts.append(_vectors.with_copies(who + a, spot, exact, firsts, count, ids[order], query_ids, k))
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        return find

    return run


def fit(base: DataFrame, id_col: str, vector_col: str, dims: int, most: int = MOST_TRAINING) -> np.ndarray:
    """Codebooks from at most about ``most`` distinct vectors, chosen by a hash of the vector."""
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    part = min(1.0, most / max(1, rows.count()))
    share = F.shiftrightunsigned(F.xxhash64("v"), 12) / F.lit(float(1 << 52))
    sample = rows.filter(share < part).groupBy("v").agg(F.min("id").alias("id")).select("id", "v").orderBy("id").limit(2 * most)
    table = sample.toArrow().cast(pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])).combine_chunks()
    value = _vectors.vectors(table.to_batches()[0], dims)[1] if len(table) else np.zeros((0, dims))
    return train(value) if len(value) else np.zeros((1, 1, dims), np.float32)


def index(base: DataFrame, books: np.ndarray, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, v, code, norm) of every row that takes part, written to the shared folder.

    It is made once, whatever the number of query blocks. Copies within a batch are encoded once.
    """
    single = isinstance(base.schema[vector_col].dataType.elementType, FloatType)
    given = base.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                ids, value = _vectors.vectors(batch.slice(a, 8192), dims)
                if not len(ids):
                    continue
                where, inverse, _ = _distinct(value)
                codes = encode(value[where], given.value)
                norms = (decode(codes, given.value) ** 2).sum(1).astype(np.float32)[inverse]
                each = value.astype(np.float32 if single else np.float64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(each) + 1, dims, dtype=np.int32)), pa.array(each))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array([x.tobytes() for x in codes[inverse]], pa.binary()), pa.array(norms)], ["id", "v", "code", "norm"])

    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return written(rows.mapInArrow(run, f"id long, v array<{'float' if single else 'double'}>, code binary, norm float"), "ann-index")


def nearest_vectors(base: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance in double precision.

    Queries are by default the rows whose id is divisible by 100; candidates are all rows with
    another id. Every row is encoded once; sums of looked-up products and the stored norm rank the
    rows of a chunk, and the ``rerank`` best distinct vectors get exact distances. Ties go to the
    smaller id. Rows take no part whose id or vector is null, that have another number of
    components, null or non-finite ones, or zeros only. A repeated query id asks once, with its
    smallest vector; repeated base rows each count. Fewer candidates give fewer rows, an empty
    table gives none. Other columns aren't read.
    """
    asked = base.filter(F.col(id_col) % 100 == 0) if queries is None else queries
    asked = asked.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    books = fit(base, id_col, vector_col, dims)
    made = index(base, books, id_col, vector_col, dims)
    given = base.sparkSession.sparkContext.broadcast(books)
    return _vectors.search(made, asked, dims, k, "double", lambda i, v: _searcher(given.value, k, rerank)(i, v), "id", "v", stored=("code", "norm"))
