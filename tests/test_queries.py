"""Every query with an oracle gives DuckDB's rows; the others run and give rows."""

import math

import pytest

from porelake import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
