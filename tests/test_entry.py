"""Every registered query of the engine against its SQL, as the driver runs them."""

import duckdb
import pytest

from quarry import catalogue

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    if name not in catalogue.ORACLES:
        assert got.count() > 0
        return
    names = sorted(got.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == names
    plain = lambda rows, cols: sorted(tuple(str(r[cols.index(n)]) for n in names) for r in rows)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
