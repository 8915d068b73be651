"""Near-duplicates at a Jaccard similarity: SimHash links first, then the pairs that SimHash can't see.

SimHash (:mod:`gridloom.llm.simhash`) links sets whose fingerprints differ in few bits. Sets at a
similarity of 0.8 differ in more bits than a multi-index search can afford to enumerate, so
the rest is found by shingles: similar sets share one of the first hashes of any order.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm._base import bounded, sent, slices, strings, tidy, written
from gridloom.llm.components import connected_components

#: A tenth of the rows, but about so many at least, show which shingles are common; at most so many of those are sent out.
SHARE, LEAST_SAMPLED, MOST_COMMON = 0.1, 60_000, 1_000_000
#: Rows of the sample from which on a shingle counts as common.
COMMON = 4
#: Sets of each meeting that are paired with others at first, and how many of such pairs a set is in.
HEADS, HEADS_A_SET = 8, 32
#: Pairs of one set that a copy of it is sent to for verification.
_PAIRS_A_COPY = 256


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of a text's shingles: A-Z lowered, words split at ASCII blanks; a shorter text is one shingle."""
    found = text.translate(simhash._LOWER).split()
    n = len(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if n else [], np.uint64)
    shingles = map(b" ".join, zip(*(found[k : n - words + 1 + k] for k in range(words)), strict=True))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n - words + 1))


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first of a set's hashes, rare ones first, of which similar sets share one at least; how many of them are rare."""
    times = np.zeros(len(found), np.int64)
    if len(common) and len(found):
        low = found.astype(np.uint32)
        at = np.minimum(np.searchsorted(common, low), len(common) - 1)
        times = np.where(common[at] == low, count[at], 0)
    first = np.lexsort((found, times))[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]
    return found[first], int((times[first] == 0).sum())


def parity(found: np.ndarray) -> bytes:
    """A bit for each of 2**k classes of hashes, k by the size of the set: whether it has an odd number of them."""
    size = 1 << max(6, (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """The least number of hashes by which two sets of these parities differ; the finer one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def _sets(docs: DataFrame, row_col: str, text_col: str, schema: str, make) -> DataFrame:
    """What ``make`` gives of each row's key and each text as bytes; a null text has no words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                yield make(part.column("row"), strings(part.column("t")).cast(pa.binary()).to_pylist())

    return bounded(docs).select(F.col(row_col).alias("row"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def common_shingles(docs: DataFrame, row_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (low 32 bits), sorted, and counts of the commonest shingles of a sample of rows, which grows with the table.

    They only set an order, in which any shingle may stand anywhere, so the sample bears on speed alone:
    the rarer the first hashes of a set are, the fewer sets it meets.
    """
    share = min(1.0, max(SHARE, LEAST_SAMPLED / max(1, docs.count())))
    some = docs.filter(F.shiftrightunsigned(F.xxhash64(row_col), 12) / F.lit(float(1 << 52)) < share)

    def make(_, texts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, words) for t in texts)]).astype(np.uint32).view(np.int32))], ["h"])

    times = _sets(some, row_col, text_col, "h int", make).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    got = times.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint32), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _repeated(batches):
    """The rows, sorted by ``h``, whose ``h`` isn't alone; one row waits for the next batch."""
    last, met = None, False
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([last, now]).combine_chunks() if last is not None else now
        if not len(now):
            continue
        h = now.column("h").to_numpy()
        keep = np.zeros(len(h), bool)
        keep[1:] = h[1:] == h[:-1]
        keep[:-1] |= keep[1:]
        keep[0] |= met
        last, met = now.slice(len(h) - 1), bool(keep[-1])
        yield from now.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).to_batches()
    if met:
        yield from last.to_batches()


def _small_hash(d: Column) -> Column:
    """The least of the hashes by which heads are chosen: heads of large groups are small by it."""
    return F.least(*[F.xxhash64(F.lit(i), d) for i in range(HEADS)])


def _can_be_similar(similarity: float) -> Column:
    """Whether sizes and what follows the first hash that sets a and b share allow the similarity."""
    few, many = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    part = similarity / (1 + similarity)
    return (few >= F.lit(similarity) * many - 1e-6) & (rest >= F.lit(part) * (F.col("a.n") + F.col("b.n")) - 1e-6)


def _pairs(a: DataFrame, b: DataFrame, other: Column, similarity: float) -> DataFrame:
    """Distinct (u, v) of rows of a and b that meet at a hash; u is the one with the smaller hash."""
    met = a.alias("a").join(b.alias("b"), (F.col("a.h") == F.col("b.h")) & other & _can_be_similar(similarity))
    return _in_order(met.select(F.col("a.d").alias("x"), F.col("b.d").alias("y")))


def _in_order(pairs: DataFrame) -> DataFrame:
    swap = F.struct(_small_hash(F.col("x")), F.col("x")) > F.struct(_small_hash(F.col("y")), F.col("y"))
    return pairs.filter("x <> y").select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("u"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("v")).distinct()


def _spots(sets: DataFrame, hashes: str, before: Column) -> DataFrame:
    """(h, d, at): each of a set's first hashes, its place in the set's order and, below that, the set's size."""
    at = F.shiftleft((F.col("pos") + F.col("before")).cast("long"), 32) + F.col("n")
    return sets.select(F.posexplode(hashes).alias("pos", "h"), before.alias("before"), "d", "n").select("h", "d", at.alias("at"))


def _bounded(similarity: float):
    """The pairs whose parities leave room for the similarity: sets of n and m that differ in k share (n + m - k) / 2 at most."""

    def run(batches):
        for batch in batches:
            n, differ = (batch.column("n").to_numpy() + batch.column("m").to_numpy()), np.fromiter(map(least_difference, batch.column("a").to_pylist(), batch.column("b").to_pylist()), np.int64, batch.num_rows)
            fit = (n - differ) * (1 + similarity) >= 2 * similarity * n - 1e-6
            yield batch.select(["u", "v"]).filter(pa.array(fit))

    return run


def groups(docs: DataFrame, row_col: str, text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, g) for every row: rows have the same g if they are linked over pairs of texts that are similar.

    Two texts are similar if the Jaccard similarity of their sets of ``words``-word shingles (by
    64-bit hash) is ``similarity`` or more; equal sets, empty ones too, are. ``row_col`` must be
    unique and the table stay as it is between readings. Repeated rows and null or blank texts are
    grouped like any other; an empty table gives no row; other columns aren't read. A task holds
    one text and its hashes at least.

    Candidates are first what SimHash links, and each set with some of those that head the hashes
    which it and others have among their first ones; then each with some heads of the groups that have
    most sets at its hashes; last, of sets still in different groups, all that meet at a hash, except
    those of the group that has most sets there. No similar pair is left out
    other than within a group. Sizes, places and parity bits of the sets bound the similarity of
    a candidate; what passes is verified on the whole sets. Copies are never paired. Hashes known to be
    common aren't gathered by a shuffle to find out that they are; joins by hash are left to skew
    handling, and a set with many candidates is copied for every few hundred of them.
    """
    with tidy(docs.sparkSession) as keep:
        return keep(written(_grouped(docs, row_col, text_col, words, similarity), "groups"))


def _grouped(docs: DataFrame, row_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(common_shingles(docs, row_col, text_col, words))
    digest = lambda x: xxhash.xxh64_intdigest(x.tobytes(), 1)

    def firsts(rows, texts):
        sets = [shingle_set(t, words) for t in texts]
        first = [prefix(x, *given.value, similarity) for x in sets]
        d = pa.array(np.array([digest(x) for x in sets], np.uint64).view(np.int64))
        fp = pa.array(np.array([simhash.majority(x, len(x)) if len(x) else 0 for x in sets], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([rows, d, pa.array(np.array([*map(len, sets)], np.int64)), fp, pa.array([parity(x) for x in sets], pa.binary()), _lists([p[:k] for p, k in first]), _lists([p[k:] for p, k in first])], ["row", "digest", "n", "fp", "odd", "rare", "usual"])

    def whole(rows, texts):
        return pa.RecordBatch.from_arrays([rows, _lists([shingle_set(t, words) for t in texts])], ["d", "x"])

    marked = written(_sets(docs, row_col, text_col, "row long, digest long, n long, fp long, odd binary, rare array<long>, usual array<long>", firsts), "sets")
    # A set goes by its first row.
    several = marked.groupBy("digest").agg(F.min("row").alias("d"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "d")
    copies = written(marked.select("row", "digest").join(several, "digest").filter("row <> d").select("row", "d"), "copies")
    single = marked.join(sent(copies.select("row")), "row", "left_anti").withColumnRenamed("row", "d")
    rare = _spots(single, "rare", F.lit(0)).repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "h long, d long, at long")
    met = rare.union(_spots(single, "usual", F.size("rare")))
    met = written(met.select("h", "d", F.shiftright("at", 32).alias("pos"), F.col("at").bitwiseAND((1 << 32) - 1).alias("n")), "met")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        ends = lambda x: x.select(F.col("u").alias("d")).union(x.select("v")).distinct()
        odd = written(single.join(sent(written(ends(pairs), "ends")), "d", "left_semi").select("d", "n", "odd"), "parities")
        sized = pairs.join(odd.select(F.col("d").alias("u"), "n", F.col("odd").alias("a")), "u").join(odd.select(F.col("d").alias("v"), F.col("n").alias("m"), F.col("odd").alias("b")), "v")
        pairs = written(sized.select("u", "v", "n", "m", "a", "b").mapInArrow(_bounded(similarity), "u long, v long"), "bounded")
        few = written(ends(pairs).withColumnRenamed("d", row_col), "asked")
        sets = written(_sets(docs.join(sent(few), row_col, "left_semi"), row_col, text_col, "d long, x array<long>", whole), "asked-sets")
        load = pairs.groupBy("u").agg(F.ceil(F.count("*") / _PAIRS_A_COPY).cast("int").alias("times"))
        spread = pairs.join(load, "u").select("u", "v", F.pmod(F.xxhash64("v"), "times").cast("int").alias("s"))
        heads = sets.select(F.col("d").alias("u"), "x").join(load, "u").select("u", "x", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("s"))
        both = spread.join(heads, ["u", "s"]).join(sets.select(F.col("d").alias("v"), F.col("x").alias("y")), "v")
        shared = both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("n"))
        return written(shared.filter(F.col("k") / (F.col("n") - F.col("k")) >= F.lit(similarity)).select("u", "v"), "links")

    # What SimHash links, by way of one set a fingerprint.
    prints = written(single.groupBy("fp").agg(F.min("d").alias("d")), "prints")
    name = lambda c, to: prints.select(F.col("fp").alias(c), F.col("d").alias(to))
    seen = simhash.links(prints.select("fp")).join(name("u", "x"), "u").join(name("v", "y"), "v").select("x", "y")
    seen = seen.union(single.select("fp", F.col("d").alias("x")).join(name("fp", "y"), "fp").filter("x <> y").select("x", "y"))

    def heads(rows: DataFrame, salt: int = 0) -> DataFrame:
        """Some rows of each hash: those with little before it in their order, which are similar to most, by several hashes."""
        early = F.shiftleft(F.floor(F.col("pos") * 64 / F.col("n")).cast("long"), 56)
        key = lambda i: early + F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col("d")), 8)
        least = [F.min(key(i)).alias(f"m{i}") for i in range(salt, salt + HEADS)]
        is_head = F.greatest(*[key(i) == F.col(f"m{i}") for i in range(salt, salt + HEADS)])
        return written(rows.join(rows.groupBy("h").agg(*least), "h").filter(is_head).select(rows.columns), "heads")

    def few_each(pairs: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("v").orderBy(_small_hash(F.col("u"))))  # a set has few heads for each of its hashes
        return pairs.withColumn("k", place).filter(F.col("k") <= HEADS_A_SET).drop("k")

    def open_(near: DataFrame) -> DataFrame:
        """What meets at the hashes of several groups, with the group that has most sets there."""
        rows = written(met.join(near, F.col("d") == F.col("node"), "left").select("h", "d", "pos", "n", F.coalesce("component", "d").alias("g")), "grouped")
        most = rows.groupBy("h", "g").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "g")).alias("m"), F.count("*").alias("several")).filter("several > 1").select("h", F.col("m.g").alias("most"))
        return written(rows.join(most, "h"), "open")

    other_set, other_group = F.col("a.d") != F.col("b.d"), F.col("a.g") != F.col("b.g")
    found = links(_in_order(seen).union(few_each(_pairs(met, heads(met), other_set, similarity))).distinct())
    for last in (False, True):
        rows = open_(written(connected_components(found), "components"))
        rest, most = rows.filter("g <> most"), rows.filter("g = most")
        found = found.union(links(_pairs(rest, rows, other_group, similarity) if last else few_each(_pairs(rest, heads(most, HEADS), other_group, similarity))))
    near = written(connected_components(found), "components")
    own = marked.select("row").join(copies, "row", "left").select("row", F.coalesce("d", "row").alias("d"))
    return own.join(near, F.col("d") == F.col("node"), "left").select("row", F.coalesce("component", "d").alias("g"))
