"""The registered queries: one or more for each operator, over the driver's tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import in_section, linear_index, local_index, rank_of
from gridloom.operators import mapreduce as M
from gridloom.operators import rows as R
from gridloom.operators.grid import Section, grid, splits
from gridloom.operators.arrays import Box
from gridloom.operators.cluster import choose_ranks, counts_by_host, hosts_in_order, one_rank_per_host, ranks_by_host, ranks_on
from gridloom.operators.reducers import Collect, Commutative, Concat, Elementwise, Flip, Fold, Max, MergeMaps, Min, Product, Stack, Sum, stack_arrays
from gridloom.operators.tree import HostTrees, OrderedTree, topology
from gridloom.plans.oracles import SQL
from gridloom.sources.ranks import read_grid

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# -- map-reduce of rows ---------------------------------------------------------------------------


@query
def mr_sum_squares(spark, sf_dir):
    return M.aggregate(table(spark, sf_dir, "orders"), F.col("o_custkey") * F.col("o_custkey"), Sum, name="s")


@query
def mr_sum_init(spark, sf_dir):
    return M.aggregate(table(spark, sf_dir, "orders"), F.col("o_custkey") * F.col("o_custkey"), Sum, init=100, name="s").select(F.col("s").cast("long").alias("s"))


@query
def mr_min_max(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ends = [M.map_reduce(orders, F.col("o_custkey"), op, name=n) for op, n in ((Min, "mn"), (Max, "mx"))]
    return ends[0].crossJoin(ends[1])  # one row each


@query
def mr_commutative_init(spark, sf_dir):
    """An operator tagged as commutative, with an initial value."""
    return M.map_reduce(table(spark, sf_dir, "orders"), F.col("o_custkey"), Commutative(Max), init=-1, name="m").select(F.col("m").cast("long").alias("m"))


@query
def mr_python_function(spark, sf_dir):
    """A Python function of each row, by Arrow batches."""
    return M.map_reduce(table(spark, sf_dir, "orders"), F.arrow_udf(_square, "long")("o_custkey"), Sum, name="s")


def _square(x: pa.Array) -> pa.Array:
    return pc.multiply(x, x)


@query
def mr_fold_merge_rounds(spark, sf_dir):
    """An ordered fold of all orders in so many partitions that partial results merge in rounds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartitionByRange(64, "o_orderkey")
    made = M.map_reduce(orders, F.struct("o_custkey", "o_custkey"), Fold(function=_ends), ["o_orderkey"], name="s")
    return made.mapInArrow(_unpickled_pair, "first long, last long")


def _ends(a: dict, b: dict) -> dict:
    """The first value of the first and the last one of the second: depends on the order."""
    (x, *_), (*_, y) = list(a.values()), list(b.values())
    return {"col1": x, "col2": y}


def _unpickled_pair(batches):
    for batch in batches:
        found = [list(pickle.loads(x).values()) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"first": pa.array([x[0] for x in found], pa.int64()), "last": pa.array([x[-1] for x in found], pa.int64())})


@query
def mr_zip_dot(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    pairs = R.zip_rows([(orders.select("o_orderkey", "o_custkey"), ["o_orderkey"]), (customer.select("c_custkey", "c_nationkey"), ["c_custkey"])])
    return pairs.agg(F.sum(F.col("o_custkey") * F.col("c_nationkey")).alias("s"), F.count("*").alias("n"))


@query
def mr_merge_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return M.map_reduce(orders, F.col("o_orderpriority"), MergeMaps(), ["o_orderkey"], key=F.col("o_custkey"), name="v").withColumnRenamed("key", "o_custkey")


@query
def mr_concat_ordered(spark, sf_dir):
    return M.map_reduce(table(spark, sf_dir, "nation"), F.col("n_name"), Concat(separator="|"), ["n_nationkey"], name="s")


@query
def mr_concat_flip(spark, sf_dir):
    return M.map_reduce(table(spark, sf_dir, "nation"), F.col("n_name"), Flip(Concat(separator="|")), ["n_nationkey"], name="s")


@query
def mr_collect_ordered(spark, sf_dir):
    """Values appended in order, shown as text."""
    made = M.map_reduce(table(spark, sf_dir, "nation"), F.col("n_regionkey"), Collect(), ["n_nationkey"], name="a")
    return made.select(F.array_join("a", ",").alias("s"))


@query
def mr_fold_ordered(spark, sf_dir):
    """An opaque Python operator that isn't commutative: texts joined, folded in order."""
    made = M.map_reduce(table(spark, sf_dir, "nation"), F.col("n_name"), Fold(function=_joined), ["n_nationkey"], name="s")
    return made.mapInArrow(_unpickled, "s string")


def _joined(a: str, b: str) -> str:
    return f"{a}|{b}"


def _unpickled(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"s": pa.array([pickle.loads(x) for x in batch.column(0).to_pylist()], pa.string())})


@query
def batch_map_ordered(spark, sf_dir):
    return M.map_batch(table(spark, sf_dir, "orders"), ["o_orderkey"], 2 * F.col("o_custkey") + 1, "v")


# -- splits of rows -------------------------------------------------------------------------------


@query
def split_rank_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return M.section_rows(orders, ["o_orderkey"], 7, n=F.count("*"), cents=F.sum("c"), lo=F.min("o_orderkey"), hi=F.max("o_orderkey"))


@query
def split_lineitem_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, F.col("l_quantity").cast("long").alias("qty"))
    return M.section_rows(lines, LINEITEM_KEY, 16, n=F.count("*"), q=F.sum("qty"))


@query
def split_local_index(spark, sf_dir):
    return R.with_rank(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7, "r", "i").select("r", "i", "o_orderkey")


@query
def split_recast(spark, sf_dir):
    return R.recast_ranks(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5, 10).withColumnRenamed("rank", "r5")


@query
def split_more_ranks_than_rows(spark, sf_dir):
    return R.with_rank(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"], 8).select("r", "r_name")


@query
def halve_floor(spark, sf_dir):
    halves = R.halve_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return halves.groupBy("side").agg(F.count("*").alias("c"), F.min("n_name").alias("mn"))


@query
def zip_slice(spark, sf_dir):
    return R.slice_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 8, 7, "rn").select("rn", "n_name")


@query
def batch_sections_one_row_per_rank(spark, sf_dir):
    return M.section_rows(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 6, n=F.count("*"))


# -- grids ----------------------------------------------------------------------------------------

_CUBE = (range(1, 6), range(2, 5), range(1, 4))


def _ranked(section: Section, spark: SparkSession, np: int) -> DataFrame:
    points = section.to_df(spark, idx="idx")
    return points.withColumns({"r": rank_of(F.col("idx"), section.grid_size, np), "i": local_index(F.col("idx"), section.grid_size, np)})


@query
def grid_product(spark, sf_dir):
    return grid(*_CUBE).to_df(spark)


@query
def grid_section(spark, sf_dir):
    return Section(_CUBE, 5, 11).to_df(spark, idx="idx")


@query
def grid_rank_and_local_index(spark, sf_dir):
    return _ranked(grid(*_CUBE), spark, 7).select("i1", "i2", "i3", "r", "i")


@query
def grid_source_partitions(spark, sf_dir):
    """The same split as physical partitions of the grid source."""
    return read_grid(spark, "1:5, 2:4, 1:3", 7).select("i1", "i2", "i3", F.col("rank").alias("r"))


@query
def grid_rank_lookup(spark, sf_dir):
    whole = grid(range(1, 6), range(2, 5))
    idx = linear_index([F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 4 + 1], whole.axes)
    return table(spark, sf_dir, "orders").select("o_orderkey", rank_of(idx, whole.grid_size, 7).alias("r"))


@query
def grid_linear_index(spark, sf_dir):
    whole = grid(range(1, 5), range(2, 9, 3))
    return whole.to_df(spark).withColumn("idx", linear_index([F.col("i1"), F.col("i2")], whole.axes))


@query
def grid_membership_count(spark, sf_dir):
    section = Section((range(1, 6), range(2, 5)), 4, 11)
    idx = linear_index([F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 4 + 1], section.axes)
    return table(spark, sf_dir, "orders").filter(in_section(idx, section)).agg(F.count("*").alias("n"))


@query
def grid_extrema_by_rank(spark, sf_dir):
    names = {f"{n}{d}": (lambda s, d=d, k=k: s.extrema(d)[k]) for d in (1, 2, 3) for k, n in enumerate(("mn", "mx"))}
    return M.section_table(spark, _CUBE, 7, **names).withColumnRenamed("rank", "r")


@query
def grid_nelements_by_rank(spark, sf_dir):
    names = {f"d{d}": (lambda s, d=d: s.n_distinct(d)) for d in (1, 2, 3)}
    return M.section_table(spark, (range(1, 6), range(1, 3), range(1, 4)), 4, **names).withColumnRenamed("rank", "r")


@query
def grid_extrema_common_last_dim(spark, sf_dir):
    axes = (range(1, 4), range(4, 8), range(2, 8))
    rows = []
    for s in splits(axes, 10):
        low, high = s.extrema_common_last()
        rows.append((s.rank, low[0][1], high[0][1], low[0][0], low[1][0], high[0][0], high[1][0]))
    return spark.createDataFrame(rows, "r long, lo long, hi long, mn1 long, mn2 long, mx1 long, mx2 long")


@query
def grid_drop_leading(spark, sf_dir):
    """Each rank's distinct tails, as sections of the grid without its first axis."""
    parts = [s.drop_leading().to_df(spark, ["i2", "i3"]).select(F.lit(s.rank).cast("long").alias("r"), "i2", "i3") for s in splits(_CUBE, 7)]
    return reduce(DataFrame.union, parts)


@query
def grid_recast_by_rank(spark, sf_dir):
    """The ranks of a split into 10 on which each section of a split into 5 falls."""
    return M.section_table(spark, _CUBE, 5, lo=lambda s: s.recast(10)[0], hi=lambda s: s.recast(10)[-1]).withColumnRenamed("rank", "r")


@query
def grid_stepped_axis(spark, sf_dir):
    return _ranked(grid(range(1, 10, 2), range(4, 7)), spark, 4).select("i1", "i2", "r")


@query
def grid_float_axis(spark, sf_dir):
    return _ranked(grid((1.0, 0.5, 3.0), range(2, 5)), spark, 4).select("i1", "i2", "r")


@query
def mr_grid_sum(spark, sf_dir):
    points = grid(range(1, 11), range(2, 21, 2)).to_df(spark)
    return M.aggregate(points, F.col("i1") * F.col("i2"), Sum, name="s")


@query
def section_batch_sum(spark, sf_dir):
    """A function of whole sections, called once a rank."""
    sums = M.map_batch_sections(spark, (range(1, 11), range(1, 11)), 4, lambda s: sum(a + b for a, b in s))
    return spark.createDataFrame(list(enumerate(sums, 1)), "r long, s long")


@query
def section_reduce_with_init(spark, sf_dir):
    total = M.map_reduce_sections(spark, (range(1, 11),), 4, lambda s: s.maximum(1), Sum, init=100)
    return spark.createDataFrame([(int(total),)], "s long")


@query
def sections_map_batch(spark, sf_dir):
    """What a function gives for each of more ranks than there are cores, in rank order."""
    made = M.map_batch_sections(spark, (range(1, 41), range(1, 3)), 30, lambda s: (s.rank, len(s), *s.extrema_dims()[0]))
    return spark.createDataFrame(made, "r long, n long, lo long, hi long")


@query
def sections_fold_ordered(spark, sf_dir):
    """An opaque operator that isn't commutative over 40 ranks."""
    text = M.map_reduce_sections(spark, (range(1, 121),), 40, lambda s: f"{s.minimum(1)}-{s.maximum(1)}", Fold(function=_joined), init="start")
    return spark.createDataFrame([(text,)], "s string")


@query
def sections_elementwise_sum(spark, sf_dir):
    """Each rank makes a matrix with its rank in its own row and ones elsewhere; their sum."""
    def matrix(s):
        out = np.ones((4, 3), np.int64)
        out[s.rank % 4] = s.rank
        return out

    total = M.map_reduce_sections(spark, (range(1, 101),), 20, matrix, Elementwise(op=Sum))
    return spark.createDataFrame([(i, j, int(total[i, j])) for i in range(4) for j in range(3)], "i long, j long, v long")


@query
def sections_elementwise_max(spark, sf_dir):
    most = M.map_reduce_sections(spark, (range(1, 101),), 20, lambda s: np.array([s.rank * 7 % 20, -s.rank]), Elementwise(op=Max))
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(most)], "i long, v long")


@query
def sections_stack(spark, sf_dir):
    """Matrices with bounds that partly overlap, summed; cells that none covers are 0."""
    boxes = lambda s: Box((s.rank, 2 * s.rank), np.full((2, 2), s.rank))
    whole = M.map_reduce_sections(spark, (range(1, 11),), 5, boxes, Stack(op=Sum))
    return spark.createDataFrame([(i + 1, j + 2, int(x)) for (i, j), x in np.ndenumerate(whole)], "i long, j long, v long")


@query
def sections_concat(spark, sf_dir):
    """Rows of numbers joined in rank order, and in the opposite one."""
    parts = [M.map_reduce_sections(spark, (range(1, 31),), 12, lambda s: np.arange(s.minimum(1), s.maximum(1) + 1), op) for op in (Concat(), Flip(Concat()))]
    return spark.createDataFrame([(k + 1, int(a), int(b)) for k, (a, b) in enumerate(zip(*parts, strict=True))], "k long, v long, flipped long")


@query
def grid_extrema_stepped_float(spark, sf_dir):
    """Extrema of a stepped and a float axis, and of all axes at once."""
    axes = ((1.0, 0.5, 3.0), range(4, 11, 3))
    rows = [(s.rank, *map(float, (s.minimum(1), s.maximum(1), *s.extrema_dims()[1]))) for s in splits(axes, 4)]
    return spark.createDataFrame(rows, "r long, mn1 double, mx1 double, mn2 double, mx2 double")


@query
def grid_halve(spark, sf_dir):
    """Both halves of each rank's section; the first is rounded down."""
    rows = [(s.rank, k, len(h)) for s in splits(_CUBE, 7) for k, h in enumerate(s.halve())]
    return spark.createDataFrame(rows, "r long, half long, n long")


# -- arrays ---------------------------------------------------------------------------------------


@query
def ew_sum_min_max(spark, sf_dir):
    made = Elementwise().reduce_many(table(spark, sf_dir, "embeddings"), "embedding", {"s": Sum, "mn": Min, "mx": Max})
    return made.withColumn("s", F.round("s", 3))


@query
def ew_product(spark, sf_dir):
    """Signs of all components; their products are exact at any size."""
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: F.when(x < 0, -1.0).otherwise(1.0)).alias("a"))
    return Elementwise(op=Product).reduce(rows, "a", value="p")


@query
def stack_sum_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    lo = F.when(F.col("label") < 5, F.col("label")).otherwise(F.col("label") + 100)
    return stack_arrays(rows, lo, F.col("embedding")).withColumn("v", F.round("v", 3))


# -- trees ----------------------------------------------------------------------------------------


@query
def tree_topology_13(spark, sf_dir):
    return topology(spark, 13)


@query
def tree_levels_13(spark, sf_dir):
    """Each node's level from the top, the levels of the whole and its top."""
    tree = OrderedTree(13)
    return spark.createDataFrame([(i, tree.level(i), tree.levels, tree.top) for i in range(1, 14)], "i long, level long, levels long, top long")


_HOSTS = {f"h{h}": [3 * h + k for k in range(1, 4)] for h in range(4)}


@query
def tree_hosts(spark, sf_dir):
    """The nodes of trees over four hosts of three ranks, and of the tree that joins them."""
    trees = HostTrees.of(_HOSTS)
    return trees.to_df(spark).withColumn("levels", F.lit(trees.levels).cast("long")).withColumn("top", F.col("rank") == trees.top_rank)


# -- hosts ----------------------------------------------------------------------------------------


def _host_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as ranks, their regions as hosts."""
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("rank"), F.concat(F.lit("h"), "n_regionkey").alias("host"))


@query
def cluster_hosts_in_order(spark, sf_dir):
    return hosts_in_order(_host_rows(spark, sf_dir)).select("host", F.array_join("ranks", ",").alias("ranks"), "n")


@query
def cluster_choice(spark, sf_dir):
    """Ranks chosen for jobs of several sizes, the own host's first; one rank a host; counts by host."""
    rows = [(r.rank, r.host) for r in _host_rows(spark, sf_dir).orderBy("rank").collect()]  # one row a rank
    ranks, hosts = [r for r, _ in rows], [h for _, h in rows]
    by = ranks_by_host(hosts, ranks)
    said = lambda x: ",".join(map(str, x))
    made = [(f"choose {n}", said(choose_ranks(ranks, n, by, "h2"))) for n in (3, 8, 40)] + [("choose 3 elsewhere", said(choose_ranks(ranks, 3, by, "other")))]
    made += [("one each", said(one_rank_per_host(by))), ("on h3", said(ranks_on(by, "h3"))), ("counts", said(counts_by_host(hosts).values()))]
    return spark.createDataFrame(made, "what string, ranks string")


_LEVELS_13 = "(values (1,4),(2,3),(3,4),(4,2),(5,4),(6,3),(7,4),(8,1),(9,4),(10,3),(11,4),(12,2),(13,3)) t(i,l)"
SQL.update({
    "mr_commutative_init": "select cast(greatest(max(o_custkey), -1) as bigint) m from orders",
    "mr_python_function": SQL["mr_sum_squares"],
    "mr_fold_merge_rounds": "select cast(arg_min(o_custkey, o_orderkey) as bigint) first, cast(arg_max(o_custkey, o_orderkey) as bigint) last from orders",
    "sections_map_batch": """
with g as (select a.i i1, ntile(30) over (order by b.i, a.i) r from range(1,41) a(i), range(1,3) b(i))
select cast(r as bigint) r, count(*) n, min(i1) lo, max(i1) hi from g group by r
""",
    "sections_fold_ordered": """
with g as (select i, ntile(40) over (order by i) r from range(1,121) t(i)), p as (select r, min(i) || '-' || max(i) s from g group by r)
select 'start|' || string_agg(s, '|' order by r) s from p
""",
    "sections_elementwise_sum": """
select i, j, cast(sum(case when r % 4 = i then r else 1 end) as bigint) v from range(0,4) a(i), range(0,3) b(j), range(1,21) c(r) group by i, j
""",
    "sections_elementwise_max": "select cast(i as bigint) i, cast(max(case when i = 0 then r * 7 % 20 else -r end) as bigint) v from range(0,2) a(i), range(1,21) c(r) group by i",
    "sections_stack": """
with x as (select r + a i, 2 * r + b j, r v from range(1,6) c(r), range(0,2) p(a), range(0,2) q(b)), s as (select i, j, sum(v) v from x group by i, j)
select g.i, h.j, cast(coalesce(s.v, 0) as bigint) v from range(1,7) g(i), range(2,12) h(j) left join s on s.i = g.i and s.j = h.j
""",
    "sections_concat": """
with g as (select i, ntile(12) over (order by i) r from range(1,31) t(i))
select row_number() over (order by a.i) k, a.i v, b.i flipped from
  (select i, row_number() over (order by r, i) n from g) a join (select i, row_number() over (order by r desc, i) n from g) b on a.n = b.n
""",
    "grid_extrema_stepped_float": """
with g as (select 1 + 0.5 * a.i x, 4 + 3 * b.i y, ntile(4) over (order by b.i, a.i) r from range(0,5) a(i), range(0,3) b(i))
select cast(r as bigint) r, cast(min(x) as double) mn1, cast(max(x) as double) mx1, cast(min(y) as double) mn2, cast(max(y) as double) mx2 from g group by r
""",
    "grid_halve": """
with g as (select ntile(7) over (order by c.i, b.i, a.i) r from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i)), n as (select r, count(*) n from g group by r)
select cast(r as bigint) r, h.half, cast(case when h.half = 0 then n // 2 else n - n // 2 end as bigint) n from n, range(0,2) h(half)
""",
    "tree_levels_13": f"select cast(i as bigint) i, cast(l as bigint) \"level\", cast(4 as bigint) levels, cast(8 as bigint) top from {_LEVELS_13}",
    "tree_hosts": """
select cast(a as bigint) rank, cast(p as bigint) process, cast(u as bigint) parent, cast(c as bigint) nchildren, h host, cast(4 as bigint) levels, a = -1 top
from (values (-2,2,2,2,'h0'),(-1,2,2,2,'h1'),(0,8,2,2,'h2'),(1,1,2,0,'h0'),(2,2,2,2,'h0'),(3,3,2,0,'h0'),(4,4,5,0,'h1'),(5,5,2,2,'h1'),(6,6,5,0,'h1'),
  (7,7,8,0,'h2'),(8,8,8,2,'h2'),(9,9,8,0,'h2'),(10,10,11,0,'h3'),(11,11,8,2,'h3'),(12,12,11,0,'h3')) t(a,p,u,c,h)
""",
    "cluster_hosts_in_order": """
select 'h' || n_regionkey host, string_agg(cast(n_nationkey + 1 as varchar), ',' order by n_nationkey) ranks, count(*) n from nation group by n_regionkey
""",
    "cluster_choice": """
with r as (select n_nationkey + 1 rank, n_regionkey reg, min(n_nationkey) over (partition by n_regionkey) first from nation),
o as (select *, row_number() over (order by reg <> 2, first, rank) k, row_number() over (order by rank) a from r)
select 'choose 3' what, string_agg(cast(rank as varchar), ',' order by k) ranks from o where k <= 3
union all select 'choose 8', string_agg(cast(rank as varchar), ',' order by k) from o where k <= 8
union all select 'choose 40', string_agg(cast(rank as varchar), ',' order by rank) from o
union all select 'choose 3 elsewhere', string_agg(cast(rank as varchar), ',' order by rank) from o where a <= 3
union all select 'one each', string_agg(cast(rank as varchar), ',' order by rank) from r where rank = first + 1
union all select 'on h3', string_agg(cast(rank as varchar), ',' order by rank) from r where reg = 3
union all select 'counts', string_agg(cast(n as varchar), ',' order by first) from (select first, count(*) n from r group by first) t
""",
    "mr_collect_ordered": "select string_agg(cast(n_regionkey as varchar), ',' order by n_nationkey) s from nation",
    "mr_fold_ordered": SQL["mr_concat_ordered"],
    "grid_source_partitions": "select i1, i2, i3, r from (" + SQL["grid_rank_and_local_index"] + ") t",
    "grid_recast_by_rank": """
with g as (select ntile(5) over (order by c.i, b.i, a.i) r, ntile(10) over (order by c.i, b.i, a.i) q
  from range(1,6) a(i), range(2,5) b(i), range(1,4) c(i))
select cast(r as bigint) r, cast(min(q) as bigint) lo, cast(max(q) as bigint) hi from g group by r
""",
})
