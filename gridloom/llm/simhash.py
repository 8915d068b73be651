"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by multi-index hashing."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, slices, strings, tidy, written
from gridloom.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 14


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A text's 64 bits as an unsigned number: A-Z lowered, words split at ASCII blanks."""
    found = text.translate(_LOWER).split()
    n = len(found)
    if not n:
        return 0
    if n <= words:
        return majority(np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64), 1)
    shingles = map(b" ".join, zip(*(found[k : n - words + 1 + k] for k in range(words)), strict=True))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n - words + 1), n - words + 1)


def majority(hashes: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes."""
    counts = np.zeros(64, np.int64)
    rows = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(0, n, _BLOCK):
        counts += np.unpackbits(rows[k : k + _BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp long) for every row; the bits of fp are the fingerprint. A null text has no words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                bits = np.array([fingerprint(x) for x in strings(part.column("t")).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bits.view(np.int64))], ["id", "fp"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def tree_edges(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (``most`` or fewer differing bits) among distinct 64-bit values."""
    edges, left = [], np.asarray(values, np.uint64)
    while len(left):
        heads, left = [left[0]], left[1:]
        while heads and len(left):
            head = heads.pop()
            near = np.bitwise_count(left ^ head) <= most
            if near.any():
                found = left[near]
                edges += [(int(head), int(x)) for x in found]
                heads += list(found)
                left = left[~near]
    return edges


def _halves(fps: DataFrame) -> DataFrame:
    """(fp, s, v): each fingerprint's two 32-bit segments, s = 0 the lower."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.posexplode(F.array(low, high)).alias("s", "v"))


def _links(batches):
    """Spanning edges within each run of equal (s, v); a run may go on in the next batch."""
    kept = None

    def linked(fp, starts):
        out = []
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a > 1:
                out += tree_edges(np.unique(fp[a:b]).view(np.uint64), 3)
        raw = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(raw[:, 0]), pa.array(raw[:, 1])], ["u", "v"])

    for batch in batches:
        s, v, fp = (batch.column(c).to_numpy() for c in ("s", "v", "fp"))
        key = v * 2 + s
        if kept is not None:
            key, fp = np.concatenate([kept[0], key]), np.concatenate([kept[1], fp])
        starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        kept = key[starts[-1] :].copy(), fp[starts[-1] :].copy()
        yield linked(fp, starts)
    if kept is not None:
        yield linked(kept[1], np.array([0, len(kept[1])]))


def links(fps: DataFrame, most_in_task: int = 4096) -> DataFrame:
    """Edges (u, v) that connect the same distinct fingerprints as all pairs at 3 bits or fewer do.

    Of two such fingerprints, one 32-bit segment differs in at most one bit. The table holds each
    fingerprint under both segments; each is also looked up under every segment with one more bit
    set (the Hamming ball of radius 1, each pair once). Within a segment value, complete distances are verified and only a spanning
    forest is kept. Segment values with more than ``most_in_task`` rows take a way without pairs:
    see :func:`_dense_links`.
    """
    table = written(_halves(fps), "segments")
    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.expr("1L").cast("long") * F.pow(F.lit(2), b).cast("long"))
    masks = F.filter(bits, lambda m: F.col("v").bitwiseAND(m) == 0)
    probes = table.select("fp", "s", F.explode(F.transform(masks, lambda m: F.col("v").bitwiseOR(m))).alias("v"))
    hits = probes.join(table.select("s", "v"), ["s", "v"], "left_semi").select("fp", "s", "v")
    rows = written(table.withColumn("own", F.lit(True)).unionByName(hits.withColumn("own", F.lit(False))), "matches")
    many = rows.groupBy("s", "v").agg(F.count("*").alias("n"))
    shared = many.filter(f"n between 2 and {most_in_task}").drop("n")
    dense = written(many.filter(f"n > {most_in_task}").drop("n"), "dense")
    few = rows.join(shared, ["s", "v"], "left_semi").select("s", "v", "fp")
    edges = few.repartition("s", "v").sortWithinPartitions("s", "v").mapInArrow(_links, "u long, v long")
    return edges.union(_dense_links(rows, dense)) if dense.take(1) else edges


def _dense_links(rows: DataFrame, dense: DataFrame) -> DataFrame:
    """The same for crowded segment values, in proportion to their rows.

    Two members whose other segments lie within 3 bits share a value z with 1 bit to the one and 2
    to the other; a member and a looked-up row within 2 bits share a z with 1 bit to each. So each
    member is put under every z within 2 bits and each looked-up row under those within 1, and all
    rows of a z are linked to its smallest member within 1 bit, if there is one: each of these
    links is at 3 bits or fewer. A z has at most a few thousand rows, since fingerprints are distinct.
    """
    ball = [(0, 0), *((1 << a, 1) for a in range(32)), *((1 << a | 1 << b, 2) for a, b in combinations(range(32), 2))]
    near = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(r).alias("r")) for m, r in ball])
    hot = rows.join(dense, ["s", "v"], "left_semi")
    other = F.when(F.col("s") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    spots = hot.select("s", "v", "fp", "own", other.alias("o"), F.explode(near).alias("b")).filter("own or b.r < 2").select("s", "v", "fp", (F.col("o").bitwiseXOR(F.col("b.m"))).alias("z"), (F.col("own") & (F.col("b.r") < 2)).alias("centre"))
    heads = spots.filter("centre").groupBy("s", "v", "z").agg(F.min("fp").alias("head"))
    return spots.join(heads, ["s", "v", "z"]).filter("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of 3 or fewer differing
    bits. Copies share a fingerprint and are never paired. A null or blank text has fingerprint
    zero and is linked like any other. A null doc_id keeps its row; it never is the smallest, so
    a group in which all are null has a null component. Repeated rows stay, an empty
    table gives no row, and other columns aren't read.
    """
    with tidy(docs.sparkSession) as keep:
        return keep(written(_components(docs, id_col, text_col), "components"))


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    groups = written(connected_components(links(distinct.select("fp"))), "components")
    smallest = distinct.join(groups, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("least").alias("c"))
    linked = groups.join(smallest, "component").select(F.col("node").alias("g"), "c")
    alone = distinct.filter("n > 1").join(groups, F.col("fp") == F.col("node"), "left_anti").select(F.col("fp").alias("g"), F.col("least").alias("c"))
    found = marked.join(linked.union(alone), F.col("fp") == F.col("g"), "left")
    own = F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("c"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))
