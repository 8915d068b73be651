"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import tidy, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node reached.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour; rounds grow with the logarithm of the longest path. A round only takes minima and
    joins, so no neighbourhood is gathered, and it is written to the shared folder. Rows with a
    null end and loops are ignored; an empty table gives no row.
    """
    with tidy(edges.sparkSession) as keep:
        return _settled(edges, most_rounds, keep)


def _settled(edges: DataFrame, most_rounds: int, keep) -> DataFrame:
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            keep(now)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        last = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        near = large.join(low, F.col("u") == F.col("n"))
        # A node's smaller neighbours and the node itself both point to the smallest neighbour.
        now = written(near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
