"""Where tasks run: hosts, the ranks on each, and the choice of ranks for a small job."""

from __future__ import annotations

import socket
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def host_map(spark: SparkSession, np: int) -> DataFrame:
    """(rank, host) of ``np`` tasks that run at the same time (a barrier stage needs that many slots)."""
    if np < 1:
        raise ValueError("at least one rank is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rank": pa.array([k + 1 for k in batch.column(0).to_pylist()], pa.int64()), "host": pa.array([socket.gethostname()] * batch.num_rows, pa.string())})

    return spark.range(0, np, 1, np).mapInArrow(run, "rank long, host string", barrier=True)


def hosts_in_order(ranks: DataFrame) -> DataFrame:
    """(host, ranks, n): each host once, in the order in which it first appears."""
    by = ranks.groupBy("host").agg(F.sort_array(F.collect_list("rank")).alias("ranks"), F.count("*").alias("n"))
    return by.orderBy(F.col("ranks")[0])


def ranks_by_host(hosts: Sequence[str], ranks: Sequence[int] | None = None) -> dict[str, list[int]]:
    """Host to ranks, both in order of first appearance."""
    out: dict[str, list[int]] = {}
    for rank, host in zip(ranks or range(1, len(hosts) + 1), hosts, strict=True):
        out.setdefault(host, []).append(rank)
    return out


def counts_by_host(hosts: Sequence[str]) -> dict[str, int]:
    return {h: len(r) for h, r in ranks_by_host(hosts).items()}


def choose_ranks(ranks: Sequence[int], n: int, by_host: Mapping[str, Sequence[int]], own_host: str | None = None) -> list[int]:
    """Ranks for a job of ``n`` items: all if there are no more than n, else the own host's first, then by host.

    If the own host has none of them, the first n are taken.
    """
    if n < 1:
        raise ValueError("at least one rank must be chosen")
    if len(ranks) <= n:
        return list(ranks)
    if own_host not in by_host:
        return list(ranks)[:n]
    order = [own_host, *(h for h in by_host if h != own_host)]
    return [r for h in order for r in by_host[h] if r in set(ranks)][:n]


def active_ranks(np: int, n: int) -> int:
    """How many ranks a job of n items uses."""
    if n < 1:
        raise ValueError("at least one rank must be chosen")
    return min(np, n)


def one_rank_per_host(by_host: Mapping[str, Sequence[int]]) -> list[int]:
    return [r[0] for r in by_host.values()]


def ranks_on(by_host: Mapping[str, Sequence[int]], host: str | None = None) -> list[int]:
    """The ranks on a host, by default the driver's."""
    return list(by_host.get(host or socket.gethostname(), []))
