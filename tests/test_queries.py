"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from voxelia import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = rows(tuple(r[c] for c in columns) for r in df.collect())
    assert found
    if name in registry.SQL:
        wanted = duck.execute(registry.SQL[name])
        names = [d[0] for d in wanted.description]
        assert sorted(names) == columns
        assert found == rows(tuple(r[names.index(c)] for c in columns) for r in wanted.fetchall())


def test_entry_works_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
