"""Array reductions of sections, errors, checkpoints and the entry's guard."""

import builtins
import os

import numpy as np
import pytest

from gridloom.operators import mapreduce as M
from gridloom.operators.arrays import Box, elementwise, stacked
from gridloom.operators.reducers import Collect, DimensionMismatch, Elementwise, Max, MergeMaps, Stack, Sum
from gridloom.plans import storage


def test_sections_of_arrays(spark):
    total = M.map_reduce_sections(spark, (range(1, 101),), 23, lambda s: np.full((2, 3, 2), float(s.rank)), Elementwise(op=Sum), init=np.full((2, 3, 2), 0.5))
    assert (total == 23 * 24 / 2 + 0.5).all() and total.shape == (2, 3, 2)
    assert M.map_reduce_sections(spark, (range(1, 101),), 23, lambda s: [s.rank], Collect()) == list(range(1, 24))
    assert M.map_reduce_sections(spark, (range(1, 11),), 6, lambda s: {s.rank % 2: s.rank}, MergeMaps()) == {0: 6, 1: 5}
    with pytest.raises(Exception, match="arrays of shape"):
        M.map_reduce_sections(spark, (range(1, 11),), 5, lambda s: np.ones(1 + s.rank // 5), Elementwise(op=Sum))
    with pytest.raises(ValueError):
        M.map_reduce_sections(spark, (range(1, 1),), 5, lambda s: 1, Sum)


def test_large_partials_merge_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "MERGE_BYTES", 1)
    assert M.map_reduce_sections(spark, (range(1, 101),), 50, lambda s: f"{s.rank},", M.Fold(function=lambda a, b: a + b)) == "".join(f"{k}," for k in range(1, 51))


def test_stack_of_boxes():
    """A cell in a gap of one partial result takes no part, whatever the operator."""
    a, b, c = Box((0,), np.array([-5])), Box((2,), np.array([-7])), Box((1,), np.array([-1, -9]))
    for first, second in (((a, b), c), ((a, c), b), ((b, c), a)):
        got = stacked(Max, None, stacked(Max, None, *first), second)
        assert got.lo == (0,) and list(got.filled()) == [-5, -1, -7]
    assert list(stacked(Sum, None, a, b).filled()) == [-5, 0, -7]
    for bad in (Box((0, 0), np.zeros((1, 1))), Box((4,), np.zeros(1))):
        with pytest.raises(DimensionMismatch):
            stacked(Sum, () if bad.values.ndim == 1 else None, a, bad)
    assert Stack(op=Sum).commutative


def test_elementwise_keeps_what_it_does_not_own():
    a = np.arange(3)
    a.flags.writeable = False
    assert list(elementwise(Sum, a, [1.5, 1, 1])) == [1.5, 2, 3] and list(a) == [0, 1, 2]
    with pytest.raises(DimensionMismatch):
        elementwise(Sum, [1], [1, 2])


@pytest.mark.parametrize("arrays", [[[1.0, 2.0], [1.0]], [[1.0], [None]], [[1.0], []], [[1.0], None]])
def test_unequal_arrays_raise(spark, arrays):
    df = spark.createDataFrame([(x,) for x in arrays], "a array<double>")
    for made in (Elementwise().reduce(df, "a"), Elementwise().reduce_many(df, "a", {"s": Sum, "m": Max})):
        with pytest.raises(Exception, match="arrays differ|without elements"):
            made.collect()


def test_checkpoints_can_be_dropped(spark):
    storage.drop_checkpoints(spark)
    storage.checkpointed(spark.range(10))
    at = storage._made[-1].removeprefix("file:")
    assert os.listdir(at)
    storage.drop_checkpoints(spark)
    assert not os.path.exists(at) and not storage._made


def test_entry_without_a_dependency(monkeypatch):
    """Where the subpackage's needs are missing, the other queries stay."""
    import sys

    import __spark_entry__ as e

    plain = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("gridloom.llm"):
            raise ImportError(name)
        return plain(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("gridloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert len(e.queries()) == len(e.catalogue.queries()) and set(e.oracle_sql()) == set(e.catalogue.oracle_sql())
