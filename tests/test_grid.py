"""Sections against the materialised product, for all splits of small grids."""

import itertools

import pytest

from gridloom.operators.grid import Axis, Section, TaskNotPresentError, grid, split, splits

GRIDS = [
    (range(1, 11),), (range(1, 11), range(4, 7)), (range(1, 11), range(4, 7), range(1, 5)), (range(1, 10, 2),), (range(1, 10, 2), range(4, 7)),
    (range(1, 3), 4, range(1, 11, 3)), ((1.0, 0.5, 3.0), range(2, 5)), (range(1, 6), range(2, 5), range(1, 4)), (range(1, 6), range(2, 3), range(1, 4)), (range(1, 6), range(1, 3), range(1, 4)),
]


def product(axes):
    values = [[a.value(k) for k in range(a.length)] for a in map(Axis.of, axes)]
    return [tuple(reversed(p)) for p in itertools.product(*reversed(values))]


@pytest.mark.parametrize("axes", GRIDS)
def test_splits_cover_the_product_in_order(axes):
    points = product(axes)
    for np in (1, 2, 3, 7, len(points), len(points) + 3):
        parts = splits(axes, np)
        assert [p for s in parts for p in s] == points
        sizes = [len(s) for s in parts]
        assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1
        for s in parts:
            for i, p in enumerate(s, 1):
                assert p in s and s.local_index(p) == i and s[i] == p
                assert s.owner(p, np) == s.rank and s.owner_and_local_index(p, np) == (s.rank, i)


@pytest.mark.parametrize("axes", GRIDS)
def test_every_section_answers_like_its_points(axes):
    points = product(axes)
    n, dims = len(points), range(1, len(axes) + 1)
    for first in range(1, n + 1, 1 if n < 50 else 5):
        for last in range(first, n + 1, 1 if n < 50 else 7):
            s, part = Section(axes, first, last), points[first - 1 : last]
            assert (s.first_point, s.last_point, len(s)) == (part[0], part[-1], len(part))
            assert s.extrema_dims() == tuple((min(c), max(c)) for c in zip(*part))
            assert [s.n_distinct(d) for d in dims] == [len(set(c)) for c in zip(*part)]
            lo, hi = min(p[-1] for p in part), max(p[-1] for p in part)
            want = [(min(p[d] for p in part if p[-1] == lo), lo) for d in range(len(axes) - 1)], [(max(p[d] for p in part if p[-1] == hi), hi) for d in range(len(axes) - 1)]
            assert s.extrema_common_last() == want
            if len(axes) > 1:
                assert list(s.drop_leading()) == list(dict.fromkeys(p[1:] for p in part))
                assert list(s.where(lo, lo)) == [p for p in part if p[-1] == lo]
            left, right = s.halve()
            assert len(left) == len(part) // 2 and [*left, *right] == part


def test_documented_values():
    assert list(Section((range(1, 4), range(4, 7)), 5, 8)) == [(2, 5), (3, 5), (1, 6), (2, 6)]
    assert split((range(1, 11), range(4, 7), range(1, 5)), 37, 8).extrema_common_last() == ([(9, 1), (6, 1)], [(2, 2), (4, 2)])
    assert split((range(1, 4), range(4, 8), range(2, 8)), 10, 2).extrema_common_last() == ([(1, 2), (6, 2)], [(3, 3), (5, 3)])
    five = Section((range(1, 6), range(2, 3), range(1, 4)), 4, 7)
    assert five.n_distinct(1) == 4
    assert Section((range(1, 6), range(1, 3), range(1, 4)), 4, 12).n_distinct(1) == 5
    empty = split((range(1, 2),), 10, 2)
    assert (empty.first, empty.last, empty.is_empty, empty.recast(3), empty.extrema_common_last()) == (2, 1, True, None, None)
    assert repr(split((range(1, 21), range(1, 31)), 4, 1)) == "150-element Split [(1, 1), ... , (10, 8)]"


def test_recast_onto_another_grid():
    s = Section((range(20, 31), range(1, 2)), 1, 11)
    axes = (range(1, 101), range(1, 4001))
    ranks = s.recast(700, axes)
    want = {grid(*axes).owner(p, 700) for p in s}
    assert (ranks[0], ranks[-1]) == (min(want), max(want))
    with pytest.raises(TaskNotPresentError):
        Section((range(20, 31), range(2, 3)), 1, 11).recast(3, (range(1, 2), range(2, 3)))


def test_huge_grids_need_no_scan():
    s = split((10**5,) * 3, 25000, 1500)
    assert (3, 3, 5998) in s and s.maximum(1) == 10**5 and s.n_distinct(3) == 4 and s.owner((1, 1, 10**5), 10**6) == 999_991


@pytest.mark.parametrize("call", [
    lambda: Axis(1, 0, 3), lambda: Axis.of((3, -1, 1)), lambda: grid(), lambda: grid(grid(3), 2), lambda: Section((3,), 0, 2), lambda: Section((3,), 1, 4), lambda: split((3,), 2, 3), lambda: split((3,), 2, 0),
    lambda: split((1,), 3, 2).extrema(), lambda: grid(3).extrema(2), lambda: grid(3).n_distinct(0), lambda: grid(3).drop_leading(), lambda: split((1,), 3, 2).first_point, lambda: grid(3).owner((1,), 0),
])
def test_errors(call):
    with pytest.raises(ValueError):
        call()


def test_lookups_off_the_grid():
    s = grid(3, 2)
    assert s.index_in_grid((4, 1)) is None and (4, 1) not in s and s.local_index((0, 1)) is None and s.owner((9, 9), 0) is None
    with pytest.raises(IndexError):
        s[7]
    assert s[-1] == (3, 2)
