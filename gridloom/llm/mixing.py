"""Mixes sources to target weights by thresholds on a hash of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._base import tidy, written

#: Bits of one level of the histograms, and levels in each of the two 60-bit keys.
BITS, LEVELS = 10, 6
WORDS = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The columns the mix needs: source, size in words, h (60 bits of a hash), t (tells repeats apart)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    return docs.withColumns({
        "__mix_source": F.col(source_col),
        "__mix_size": F.regexp_count(text, F.lit(WORDS)).cast("long"),
        "__mix_h": F.conv(F.substring(name, 1, 15), 16, 10).cast("long"),
        "__mix_t": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4),
    })


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target): the words each source is to give; one row a source.

    Weights go round the sources by code point, null last. All targets sum to ``share`` times all
    words; one above ``repeats`` times its source's words stops there and the excess is shared out
    again by weight. That is target = min(cap, level * weight), with one level for all sources,
    which a running sum over sources by cap / weight finds.
    """
    if not 0 <= share <= repeats or min(weights) <= 0:
        raise ValueError("share lies between 0 and repeats, and weights are positive")
    by = sizes.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("__mix_size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1))
    order = Window.orderBy("ratio", "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    by = by.withColumn("level", level)
    first = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", first)
    return by.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.col("cap").cast("double")).alias("target"))


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target, times, upto, h, t, bits): what each source's documents go by.

    Every document is taken ``times`` times and those below the threshold once more, so the sets
    for each further round of a source are nested. The threshold is found by histograms of words
    by source and hash bucket: the bucket in which the budget ends is the only one refined, by the
    next bits, until it holds one document. It's taken if that brings the sum nearer the budget.
    Only rows with the same id and text are left for the bits of t. Below the first level only the
    rows of open buckets are read, a thousandth or so, from a table of their own. There is one row a source in
    these tables, and windows over them run in one task: sources are names of corpora, not hosts.
    """
    with tidy(sizes.sparkSession) as keep:
        return _refined(sizes, weights, share, repeats, keep)


def _refined(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int, keep) -> DataFrame:
    at = targets(sizes, weights, share, repeats)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    at = at.withColumn("times", times.cast("int")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    at = written(at.withColumns({"h": F.lit(0).cast("long"), "t": F.lit(0).cast("long"), "rows": F.lit(2).cast("long"), "bits": F.lit(0), "mass": F.lit(0).cast("long")}), "mix-level")
    same = F.col("__mix_source").eqNullSafe(F.col("source"))
    for level in range(2 * LEVELS):
        open_ = at.filter("rest > 0 and rows > 1")
        if not open_.take(1):
            break
        key = "h" if level < LEVELS else "t"
        shift = BITS * (LEVELS - 1 - level % LEVELS)
        inside = F.shiftrightunsigned(f"__mix_{key}", shift + BITS) == F.col(key)
        if key == "t":
            inside &= F.col("__mix_h") == F.col("h")
        digit = F.shiftrightunsigned(f"__mix_{key}", shift).bitwiseAND((1 << BITS) - 1)
        rows = sizes.join(open_.select("source", "h", "t"), same).filter(inside)
        if level == 1:
            sizes = written(rows.select(*sizes.columns), "mix-open")
            rows = sizes.join(open_.select("source", "h", "t"), same).filter(inside)
        histogram = rows.groupBy("source", digit.alias("digit")).agg(F.sum("__mix_size").alias("mass"), F.count("*").alias("rows"))
        upto = F.sum("mass").over(Window.partitionBy("source").orderBy("digit"))
        marked = open_.drop("mass", "rows").join(histogram.withColumn("upto", upto).withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        ends = marked.filter("upto >= rest and upto - mass < rest").withColumn("rest", F.col("rest") - (F.col("upto") - F.col("mass")))
        ends = ends.withColumn(key, F.col(key) * (1 << BITS) + F.col("digit")).withColumn("bits", F.lit((level + 1) * BITS)).select(*at.columns)
        at = written(at.filter("not (rest > 0 and rows > 1)").unionByName(ends), "mix-level")
    return keep(at).withColumn("upto", F.col("mass") <= 2 * F.col("rest"))


def mix(docs: DataFrame, bounds: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", made: bool = False) -> DataFrame:
    """The documents with __mix_times, how often the mix takes each, and the bounds' columns as __mix_*.

    Null ids, texts and sources are values like others (a null text has no words and weighs
    nothing); repeated rows are judged row by row; an empty table gives no row. Further columns are kept; names
    that begin with ``__mix_`` or ``__b_`` are not allowed.
    """
    rows = docs if made else keyed(docs, id_col, text_col, source_col)
    by = bounds.select(*[F.col(c).alias(f"__b_{c}") for c in bounds.columns])
    rows = rows.join(by, F.col("__mix_source").eqNullSafe(F.col("__b_source")), "left")
    h_bits, t_bits = F.least(F.col("__b_bits"), F.lit(BITS * LEVELS)), F.greatest(F.col("__b_bits") - BITS * LEVELS, F.lit(0))
    cut = lambda c, n: F.expr(f"shiftrightunsigned({c}, {BITS * LEVELS} - {n})")
    rows = rows.withColumn("__h", F.least(h_bits, F.lit(BITS * LEVELS))).withColumn("__t", t_bits)
    h, t = cut("__mix_h", "__h"), cut("__mix_t", "__t")
    below = (h < F.col("__b_h")) | ((h == F.col("__b_h")) & ((t < F.col("__b_t")) | ((t == F.col("__b_t")) & F.col("__b_upto"))))
    more = F.when((F.col("__b_rest") > 0) & below, 1).otherwise(0)
    return rows.withColumn("__mix_times", F.col("__b_times") + more)


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted).

    Odd rows are treated as :func:`mix` says; other columns aren't read, so their names don't matter. Texts are counted in
    the JVM, one row at a time.
    """
    slim = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "doc_id", "text", "source")
    sizes = written(slim.drop("text", "source"), "mix-sizes")
    rows = mix(sizes, thresholds(sizes, weights, share, repeats), made=True)
    return rows.select("doc_id", F.col("__mix_size").alias("size"), F.col("__b_source_size").alias("source_size"), F.col("__b_target").alias("target"), (F.col("__mix_size") * F.col("__mix_times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, all columns kept whatever their names, each row as often as the mix takes it.

    Null ids, texts and sources are values like others; rows without words go unless their source gives each row; repeated rows are judged one by one;
    an empty table gives no row.
    """
    slim = keyed(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x"), F.col(source_col).alias("s")), "i", "x", "s")
    bounds = thresholds(written(slim.drop("i", "x", "s"), "mix-sizes"), weights, share, repeats)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__i"), F.col(text_col).alias("__x"), F.col(source_col).alias("__s"))
    rows = mix(packed, bounds, "__i", "__x", "__s").filter("__mix_times > 0")
    return rows.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__mix_times")))).select("__row.*")


#: DuckDB SQL for :func:`mixture` of ``documents`` with the default weights, share and repeats. It takes rows with the
#: same source, id and text together, which the operator tells apart where a budget ends between them.
MIXTURE_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast(('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))), 1, 15)) as bigint) as h
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as turn from d group by source),
w as (
  select *, [5, 2, 1][turn % 3 + 1] as weight, 2 * source_size as cap, cast(2 * source_size as double) / [5, 2, 1][turn % 3 + 1] as ratio from s),
l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by ratio, turn rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, turn rows between current row and unbounded following) as level from w),
f as (select arg_min(level, ratio) filter (ratio > level) as level from l),
t as (
  select source, source_size, coalesce(least(cast(cap as double), f.level * weight), cast(cap as double)) as target from l, f),
e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as times from t),
r as (
  select d.doc_id, d.size, e.source_size, e.target, e.times, e.target - e.times * e.source_size as rest,
    sum(d.size) over (partition by d.source order by d.h) as upto, sum(d.size) over (partition by d.source, d.h) as mass
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target,
  cast(size * (times + case when rest > 0 and (upto < rest or (upto - mass < rest and mass <= 2 * (rest - (upto - mass)))) then 1 else 0 end) as bigint) as taken
from r
"""
