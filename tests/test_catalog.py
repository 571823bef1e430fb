"""Every registered query of the core against its SQL statement on the same tables."""

import math

import duckdb
import pytest

from cairn.catalog import features, files, raster, rays, scalar, vector, view

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {n: (f, m.SQL.get(n)) for m in (raster, vector, rays, scalar, features, view, files) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 7) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_equals_sql(spark, sf, duck, name):
    query, sql = ALL[name]
    got = query(spark, sf)
    cursor = duck.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str) == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["grid", "row", "col", "rank", "score"]
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
