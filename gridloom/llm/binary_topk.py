"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _vectors


def sign_codes(value: np.ndarray) -> np.ndarray:
    """64-bit codes: bit j says whether component j is 0 or more (dimensions beyond 64 are not allowed)."""
    n, d = value.shape
    if d > 64:
        raise ValueError("codes have at most 64 bits")
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :d] = value >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """Tables of distinct codes by each of ``segments`` equal segments: 4 of 16 bits or 8 of 8 bits."""

    def __init__(self, codes: np.ndarray, segments: int = 4):
        if segments not in (4, 8):
            raise ValueError("4 or 8 segments")
        self.codes, self.m, self.width = np.ascontiguousarray(codes, "<u8"), segments, 64 // segments
        parts = self._split(self.codes).astype(np.int64)
        self.order = [np.argsort(part, kind="stable") for part in parts.T]
        self.starts = [np.append(0, np.cumsum(np.bincount(part, minlength=1 << self.width))) for part in parts.T]
        self.values = [np.flatnonzero(np.diff(s)) for s in self.starts]
        self.looked_up = self.verified = 0

    def _split(self, codes: np.ndarray) -> np.ndarray:
        """The segments of each code, lowest first."""
        return np.ascontiguousarray(codes, "<u8").view(f"<u{self.width // 8}").reshape(-1, self.m)

    def _matches(self, segment: int, part: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of table entries whose segment differs in exactly ``radius`` bits."""
        values, starts = self.values[segment], self.starts[segment]
        masks = _masks(self.width, radius)
        if len(masks) < len(values):
            slot = (part[:, None] ^ masks[None, :]).reshape(-1)
            q = np.repeat(np.arange(len(part)), len(masks))
        else:  # the ball has more values than the table: go through the table's
            q, hit = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) == radius)
            slot = values[hit]
        self.looked_up += len(part) * min(len(masks), len(values))
        n = starts[slot + 1] - starts[slot]
        some = np.flatnonzero(n)
        q, slot, n = q[some], slot[some], n[some]
        spot = np.repeat(starts[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(q, n), self.order[segment][spot]

    def nearest(self, queries: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance) of every code as near as the k-th nearest, and no farther than ``most``, for each query.

        Radius 0, 1, ... is searched in all segments. A code that none of them has shown differs
        in more than the radius in each segment, so all within segments * (radius + 1) - 1 are known; a query ends
        when its k-th verified distance is no more than that. A code is verified once: at the
        radius of its nearest segment, by the first such segment.
        """
        parts, enough = self._split(queries), min(k, len(self.codes))
        active, found = np.arange(len(queries)), []
        tally = np.zeros((len(queries), 65), np.int64)
        edge = np.full(len(queries), 64) if most is None else np.minimum(most, 64).astype(np.int64)
        for radius in range(self.width + 1 if enough else 0):
            for s in range(self.m):
                q, place = self._matches(s, parts[active, s].astype(np.int64), radius)
                q = active[q]
                differ = self.codes[place] ^ queries[q]
                apart = np.bitwise_count(self._split(differ))
                new = (apart >= radius).all(axis=1) & (apart[:, :s] > radius).all(axis=1)
                q, place, distance = q[new], place[new], apart[new].sum(axis=1, dtype=np.int64)
                self.verified += len(q)
                tally += np.bincount(q * 65 + distance, minlength=tally.size).reshape(tally.shape)
                near = distance <= edge[q]
                found.append((q[near], place[near], distance[near]))
            upto = np.cumsum(tally, axis=1) >= enough
            edge = np.where(upto.any(axis=1), np.minimum(edge, upto.argmax(axis=1)), edge)
            active = active[edge[active] > self.m * (radius + 1) - 1]
            if not len(active):
                break
        q, place, distance = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        near = distance <= edge[q]
        return q[near], place[near], distance[near]


def _searcher(k: int, segments: int):
    def run(query_ids: np.ndarray, query_vectors: np.ndarray):
        asked = sign_codes(query_vectors)

        def find(ids: np.ndarray, value: np.ndarray, bound: np.ndarray):
            codes = sign_codes(value)
            order = np.lexsort((ids, codes))
            distinct, firsts, count = np.unique(codes[order], return_index=True, return_counts=True)
            parts, index = [], Index(distinct, segments)
            for a in range(0, len(asked), 1024):
                q, place, distance = index.nearest(asked[a : a + 1024], k + 1, bound[a : a + 1024])  # one more, for the query itself
                parts.append(_vectors.with_copies(q + a, place, distance.astype(np.int32), firsts, count, ids[order], query_ids, k))
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        return find

    return run


def nearest_codes(base: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, segments: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, distance): each query's k nearest rows by Hamming distance of sign codes.

    Queries are by default the rows whose id is divisible by 100; candidates are all rows
    with another id. Ties go to the smaller id. Rows take no part whose id or vector is null, that
    have another number of components, null or non-finite ones, or zeros only. A repeated query id
    asks once, with its smallest vector; repeated base rows each count. Fewer candidates than k
    give fewer rows; an empty table gives none. Copies of a code are one entry of the tables. Other
    columns aren't read. A task holds the tables of 32,768 rows; a query's k-th distance among the
    rows before bounds the radii in the next ones.
    """
    asked = base.filter(F.col(id_col) % 100 == 0) if queries is None else queries
    found = _vectors.search(base, asked, dims, k, "int", _searcher(k, segments), id_col, vector_col)
    return found.select("query_id", "rank", "vec_id", F.col("score").alias("distance"))


#: DuckDB SQL for :func:`nearest_codes` of ``embeddings``, by brute force.
NEAREST_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: x >= 0) as bits from embeddings
  where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (
  select q.vec_id as query_id, b.vec_id, len(list_filter(list_zip(q.bits, b.bits), lambda x: x[1] <> x[2])) as distance
  from e q join e b on q.vec_id % 100 = 0 and q.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
select query_id, cast(rank as integer) as rank, vec_id, cast(distance as integer) as distance from r where rank <= 10
"""
