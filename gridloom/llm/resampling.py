"""Quality filter by importance resampling: hashed n-gram models of good text and of all text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, slices, written
from gridloom.llm.textcut import cut

#: Buckets of n-gram hashes; a model is a vector of this many counts.
BUCKETS = 1 << 15
#: Most labelled documents that are used, a half for the target model and a half to set the cut.
MOST_LABELS = 20_000
#: Share of good held-out documents that may score below the cut.
LOST = 0.002
SEED = 7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the unigrams, unigrams a text, buckets of the bigrams, bigrams a text.

    The grams are the chunks of :func:`gridloom.llm.textcut.cut`: words with the blank before
    them, and marks. A null or empty text has none.
    """
    codes, distinct, firsts, _ = cut(texts)
    n = np.diff(firsts)
    if not len(codes):
        return np.zeros(0, np.int64), n, np.zeros(0, np.int64), n
    raw = distinct.cast(pa.binary()).to_pylist()
    word = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))[codes]
    pair = (word[:-1] * _MIX) ^ word[1:]
    pair ^= pair >> np.uint64(29)
    inner = np.ones(len(codes), bool)
    inner[firsts[1:][n > 0] - 1] = False
    few = np.uint64(BUCKETS - 1)
    return (word & few).astype(np.int64), n, (pair & few)[inner[:-1]].astype(np.int64), np.maximum(n - 1, 0)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of n values; each depends on its own values only."""
    out, some = np.zeros(len(n)), n > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some])
    return out


def log_weights(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Each text's log importance weight: the sum of its grams' log ratios."""
    return weights_and_roots(texts, ratio)[0]


def weights_and_roots(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log weights and the roots of the numbers of grams, by which weights of short and long texts compare."""
    words, n, pairs, m = features(texts)
    return _sums(ratio[words], n) + _sums(ratio[pairs], m), np.sqrt(np.maximum(n + m, 1).astype(float))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(gram | target) - log p(gram | raw) with one added to each count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


class Model:
    """What :func:`fit` finds: the ratios, and the perturbed score that the k-th document has."""

    def __init__(self, ratio: np.ndarray, cut: float, kept: int):
        self.ratio, self.cut, self.kept = ratio, cut, kept


def _noise_bits(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col))


def _gumbel(bits: str) -> Column:
    """Standard Gumbel noise from 52 bits of a hash."""
    return -F.log(-F.log((F.shiftrightunsigned(bits, 12) + F.lit(0.5)) / F.lit(float(1 << 52))))


def labelled_sample(labels: DataFrame, id_col: str, quality_col: str, most: int) -> DataFrame:
    """(id, good, held): about ``most`` labelled ids by hash; an id with several labels is good if all are."""
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.min(quality_col) > 0).alias("__good"))
    ids = written(ids.withColumn("r", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "__id"), 12) / F.lit(float(1 << 52))), "labels")
    part = min(1.0, most / max(1, ids.count()))
    return written(ids.filter(F.col("r") < part).select("__id", "__good", (F.col("r") * 1000003 % 2 < 1).alias("__held")), "label-sample")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by histograms that refine only the bin that holds it."""
    rows = values.select(F.col(column).alias("x"))
    while True:
        low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if k >= n:
            return low
        if not high - low > 0 or not (high - low) / bins > 0:
            return high
        bin_ = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
        above, spot = 0, None
        for b, c in sorted(((r.b, r.c) for r in rows.groupBy(bin_.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True):
            if above + c >= k:
                spot = b
                break
            above += c
        k, rows = k - above, rows.filter(bin_ == spot)


def _scored(docs: DataFrame, sample: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(id, log_weight, weight, key, good, held) for every document; weight and key are over the root of its grams.

    Only the texts go to Python. With ``carry``, all columns stay beside as the struct ``row``.
    """
    given = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(texts: pa.Array) -> pa.Array:
        parts = [weights_and_roots(x.column("t"), given.value) for x in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
        both = [np.concatenate([np.zeros(0), *x]) for x in zip(*parts, strict=True)] or [np.zeros(0)] * 2
        return pa.StructArray.from_arrays([pa.array(x) for x in both], ["w", "root"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), _noise_bits(id_col, text_col).alias("bits"), F.arrow_udf(score, "w double, root double")(F.col(text_col)).alias("s"), *[row] * carry)
    scored = rows.join(F.broadcast(sample), F.col("id") == F.col("__id"), "left")
    w, root = F.col("s.w"), F.col("s.root")
    return written(scored.select("id", w.alias("log_weight"), (w / root).alias("weight"), ((w + _gumbel("bits")) / root).alias("key"), F.col("__good").alias("good"), F.col("__held").alias("held"), *["row"] * carry), "weights")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", most_labels: int = MOST_LABELS, lost: float = LOST, carry: bool = False) -> tuple[Model, DataFrame]:
    """The model, and every document's log weight and perturbed key (with ``carry`` also its ``row``).

    The raw model counts the grams of all documents, the target model those of the labelled good
    ones (half of a sample of at most about ``most_labels`` labels). k is the number of documents
    whose weight, over the root of their grams so that lengths compare, reaches the quantile
    ``lost`` of the held-out good ones; without any, all are kept.
    """
    sample = labelled_sample(labels, id_col, quality_col, most_labels)
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("__id"), "left").select("t", F.coalesce(F.col("__good") & ~F.col("__held"), F.lit(False)).alias("target"))

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                words, n, pairs, m = features(part.column("t"))
                total[0] += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
                if (good := part.column("target").to_numpy(zero_copy_only=False)).any():
                    total[1] += np.bincount(words[np.repeat(good, n)], minlength=BUCKETS) + np.bincount(pairs[np.repeat(good, m)], minlength=BUCKETS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)], ["bucket", "raw", "target"])

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = log_ratio(target, raw) if target.any() else np.zeros(BUCKETS)
    scored = _scored(docs, sample, ratio, id_col, text_col, carry)
    low = scored.filter("good and held").agg(F.percentile_approx("weight", lost, 10_000)).first()[0]
    low = -math.inf if low is None else low
    k = scored.filter(F.col("weight") >= F.lit(float(low))).count()
    edge = kth_largest(scored, "key", k) if k else math.inf
    return Model(ratio, edge if edge is not None else -math.inf, k), scored


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the resampling keeps: doc_id, log_weight, key, keep (true).

    Gumbel top-k: the k largest of log weight plus Gumbel noise are a sample without replacement
    by importance weight. Both are divided by the root of the number of grams, since sums of few
    and of many log ratios don't compare. The noise comes from a hash of id and text, so reruns agree. Rows
    level with the k-th are all kept, repeated rows stand or fall together, a null or empty text
    weighs 0, null ids are kept as they are, and empty tables give no row. Labels may be null,
    missing or contradict each other. Other columns aren't read, so their names don't matter. A
    text is the least that a task holds: about 40 times its bytes while its grams are counted.
    """
    model, scored = fit(docs, labels, **options)
    return scored.filter(F.col("key") >= F.lit(model.cut)).select(F.col("id").alias("doc_id"), "log_weight", "key", F.lit(True).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that :func:`resample` keeps, with all their columns; odd rows are treated as there.

    The rows are written once beside their keys, so no text is scored twice or sent back by Python.
    Columns of any name are kept. Rows level with the k-th key are all kept.
    """
    model, scored = fit(docs, labels, carry=True, **options)
    return scored.filter(F.col("key") >= F.lit(model.cut)).select("row.*")
