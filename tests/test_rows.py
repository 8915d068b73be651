"""Splits of rows, expressions, reducers and map-reduce, against plain Python."""

import functools

import pytest
from pyspark.sql import functions as F

from gridloom.functions.exprs import decode, in_section, linear_index, local_index, rank_of
from gridloom.operators import mapreduce as M
from gridloom.operators import rows as R
from gridloom.operators.grid import Section, grid, splits
from gridloom.operators.reducers import Collect, Commutative, Concat, DimensionMismatch, Elementwise, Flip, Fold, MergeMaps, Min, Product, Stack, Sum, stack_arrays, zip_arrays
from gridloom.sources.ranks import read_grid


def ranks(n, np):
    d, r = divmod(n, np)
    return [p for p in range(1, np + 1) for _ in range(d + (p <= r))]


@pytest.mark.parametrize("n,np", [(10, 4), (3, 8), (7, 7), (20, 1)])
def test_rank_expressions(spark, n, np):
    rows = spark.range(1, n + 1).select("id", rank_of(F.col("id"), n, np).alias("r"), local_index(F.col("id"), n, np).alias("i")).orderBy("id").collect()
    assert [x.r for x in rows] == ranks(n, np)
    seen = {}
    assert [x.i for x in rows] == [seen.setdefault(x.r, []).append(1) or len(seen[x.r]) for x in rows]


def test_with_rank_over_many_partitions(spark):
    df = spark.range(0, 101, 1, 7).select((F.col("id") * 37 % 101).alias("k"), F.lit("x").alias("idx0"))
    rows = R.with_rank(df.repartition(5), ["k"], 8, "r", "i").orderBy("k").collect()
    assert [x.r for x in rows] == ranks(101, 8) and rows[13].i == 1
    assert R.with_rank(df.limit(0), ["k"], 3).count() == 0
    assert [x.k for x in R.split_rows(df, ["k"], 8, 2).orderBy("k").collect()] == list(range(13, 26))
    assert [x.k for x in R.slice_rows(df, ["k"], 4, 3).orderBy("k").collect()] == [4, 5, 6]
    assert R.halve_rows(df, ["k"]).filter("side = 'L'").count() == 50
    zipped = R.zip_rows([(df.select("k"), ["k"]), (spark.range(5).select((-F.col("id")).alias("j")), ["j"])]).orderBy("k").collect()
    assert [(x.k, x.j) for x in zipped] == [(0, -4), (1, -3), (2, -2), (3, -1), (4, 0)]
    with pytest.raises(ValueError):
        R.with_rank(df, ["k"], 0)


def test_numbers_by_joined_offsets(spark, monkeypatch):
    monkeypatch.setattr(R, "_IN_EXPRESSION", 1)
    rows = R.number_rows(spark.range(50).repartition(5), ["id"]).df.collect()
    assert all(r.idx == r.id + 1 for r in rows) and rows[0].asDict().keys() == {"id", "idx"}


def test_grid_columns(spark):
    section = Section((range(1, 10, 2), (1.0, 0.5, 3.0), range(4, 7)), 7, 50)
    rows = section.to_df(spark, idx="n").orderBy("n").collect()
    assert [tuple(r)[1:] for r in rows] == list(section) and [r.n for r in rows] == list(range(7, 51))
    back = section.to_df(spark, idx="n").withColumn("m", linear_index([F.col("i1"), F.col("i2"), F.col("i3")], section.axes))
    assert back.filter("n <> m or m is null").count() == 0
    odd = spark.createDataFrame([(2, 1.0, 4), (1, 1.2, 4), (1, 1.0, 9), (None, 1.0, 4)], "a long, b double, c long")
    assert [r.m for r in odd.select(linear_index([F.col("a"), F.col("b"), F.col("c")], section.axes).alias("m")).collect()] == [None] * 4
    assert [r.x for r in spark.range(6, 9).select(in_section(F.col("id"), section).alias("x")).orderBy("id").collect()] == [False, True, True]
    assert [f.dataType for f in section.to_df(spark).schema] == [f.dataType for f in section.schema]
    assert len(decode(F.col("id"), section.axes)) == 3


def test_source_has_one_partition_a_rank(spark):
    df = read_grid(spark, "1:5, 2:4", 4)
    assert df.rdd.getNumPartitions() == 4
    got = {}
    for r in df.orderBy("idx").collect():
        got.setdefault(r["rank"], []).append((r.i1, r.i2))
    assert got == {s.rank: list(s) for s in splits((range(1, 6), range(2, 5)), 4)}


def test_metadata_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    s = grid(1000, 1000, 1000)
    s.extrema_dims(), s.owner((5, 5, 5), 999), s.n_distinct(2), s.recast(77)
    assert set(tracker.getJobIdsForGroup()) == before


# -- reductions -----------------------------------------------------------------------------------


def letters(spark, n=40):
    return spark.range(n).repartition(6).select(F.col("id").alias("k"), F.chr(97 + F.col("id") % 26).alias("c"))


def test_ordered_reductions(spark):
    df, text = letters(spark), "".join(chr(97 + i % 26) for i in range(40))
    assert M.map_reduce(df, F.col("c"), Concat(), ["k"]).first()[0] == text
    assert M.map_reduce(df, F.col("c"), Flip(Concat()), ["k"]).first()[0] == text[::-1]
    assert M.map_reduce(df, F.col("k"), Collect(), ["k"]).first()[0] == list(range(40))
    add = Fold(function=lambda a, b: a + b)
    assert M.fold_value(M.map_reduce(df, F.col("c"), add, ["k"])) == text
    assert M.fold_value(M.map_reduce(df, F.col("c"), add, ["k"], init="!")) == "!" + text
    assert M.fold_value(M.map_reduce(df, F.col("c"), Flip(add), ["k"])) == text[::-1]
    assert Flip(Flip(add)) == add and Flip(Commutative(add)).commutative
    with pytest.raises(ValueError):
        M.map_reduce(df, F.col("c"), add)


def test_fold_in_several_rounds(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(400).repartition(40)
        got = M.fold_value(M.map_reduce(df, F.col("id"), Fold(function=lambda a, b: f"{a},{b}"), ["id"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == ",".join(map(str, range(400)))


def test_init_is_used_once_and_empty_input(spark):
    df, none = spark.range(1, 11), spark.range(0)
    square = F.col("id") * F.col("id")
    assert M.map_reduce(df, square, Sum).first()[0] == 385
    assert M.map_reduce(df, square, Sum, init=100).first()[0] == 485
    assert M.map_reduce(df, F.col("id"), Min, init=-3).first()[0] == -3
    assert M.map_reduce(df, F.col("id"), Product).first()[0] == 3628800.0
    assert M.map_reduce(none, square, Sum, init=100).first()[0] == 100
    assert M.fold_value(M.map_reduce(none, F.col("id"), Fold(), ["id"], init=5)) == 5
    for op in (Sum, Fold()):
        with pytest.raises(M.EmptyInput):
            M.map_reduce(none, F.col("id"), op, ["id"])


def test_maps_keep_the_last_value(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", 3)], "o long, k string, v long")
    get = lambda op: {r.key: r.value for r in M.map_reduce(df, F.col("v"), op, ["o"], key=F.col("k")).collect()}
    assert get(MergeMaps()) == {"a": 3, "b": 2} and get(Flip(MergeMaps())) == {"a": 1, "b": 2}


def test_sections(spark):
    axes = (range(1, 11), range(1, 5))
    assert M.map_reduce_sections(spark, axes, 7, lambda s: [s.first_point], Fold(function=lambda a, b: a + b)) == [s.first_point for s in splits(axes, 7)]
    assert M.map_reduce_sections(spark, (3,), 8, lambda s: s.rank, Fold(function=lambda a, b: a * 10 + b), init=0) == 123
    assert M.map_batch_sections(spark, axes, 50, len) == [1] * 40
    assert M.serial_map_reduce([1, 2, 3], lambda x: x * x, lambda a, b: a + b, 100) == 114
    table = M.section_table(spark, axes, 3, n=len).orderBy("rank").collect()
    assert [r.n for r in table] == [14, 13, 13]


def test_a_failing_task_fails_the_call(spark):
    with pytest.raises(Exception, match="no luck"):
        M.map_batch_sections(spark, (4,), 2, lambda s: (_ for _ in ()).throw(RuntimeError("no luck")))
    with pytest.raises(Exception, match="no luck"):
        M.fold_value(M.map_reduce(spark.range(4), F.col("id"), Fold(function=lambda a, b: (_ for _ in ()).throw(RuntimeError("no luck"))), ["id"]))


# -- arrays ---------------------------------------------------------------------------------------


def test_elementwise(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), ([5.0, 6.0],)], "a array<double>")
    get = lambda op: [r.v for r in Elementwise(op=op).reduce(df, "a").orderBy("pos").collect()]
    assert get(Sum) == [9.0, 12.0] and get(Product) == [15.0, 48.0] and get(Min) == [1.0, 2.0]
    Elementwise.check(df, "a")
    for bad in ([([1.0],), ([1.0, 2.0],)], [([None],)]):
        with pytest.raises(DimensionMismatch):
            Elementwise.check(spark.createDataFrame(bad, "a array<double>"), "a")
    two = spark.createDataFrame([([1, 2], [3, 4]), ([1], [3, 4])], "a array<long>, b array<long>")
    assert [r.c for r in two.select(zip_arrays(lambda a, b: a + b, F.col("a"), F.col("b")).alias("c")).collect()] == [[4, 6], [4, 5]]
    with pytest.raises(Exception, match="length"):
        spark.createDataFrame([([1, 2], [1, 2, 3])], "a array<long>, b array<long>").select(zip_arrays(lambda a, b: a + b, F.col("a"), F.col("b"))).collect()


def test_stacking(spark):
    df = spark.createDataFrame([(2, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0])], "lo long, a array<double>")
    got = stack_arrays(df, F.col("lo"), F.col("a")).orderBy("idx").collect()
    assert [(r.idx, r.v) for r in got] == [(2, 1.0), (3, 2.0), (4, 2.0), (5, 1.0)]
    cells = [("x", i, j, 1) for i in (1, 2) for j in (2, 3, 4)] + [("y", i, j, 1) for i in (2, 3) for j in (3, 4, 5)]
    df = spark.createDataFrame(cells, "k string, i long, j long, v long")
    got = {(r.i, r.j): r.v for r in Stack().reduce(df, ["i", "j"]).collect()}
    assert len(got) == 12 and got[1, 5] == got[3, 2] == 0 and got[2, 3] == 2 and got[1, 2] == 1
    assert {(r.i, r.j): r.v for r in Stack(op=Min).reduce(df.withColumn("v", F.lit(-4)), ["i", "j"]).collect()}[1, 5] == 0
    with pytest.raises(DimensionMismatch):
        Stack(dims=(1,)).reduce(df, ["i", "j"], key="k")
    with pytest.raises(ValueError):
        Stack(dims=(3,)).reduce(df, ["i", "j"])
    assert functools.reduce(lambda a, b: a + b, got.values()) == 12
