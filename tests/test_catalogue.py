"""Every registered query of the library against its SQL on DuckDB."""

import pytest


from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    names = sorted(got.columns)
    assert sorted(want.column_names) == names
    rows = lambda data: sorted((tuple(r[c] for c in names) for r in data), key=repr)
    assert rows(r.asDict() for r in got.collect()) == rows(want.to_pylist())


def test_each_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())
