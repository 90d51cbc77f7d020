"""Every query that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from clipmotif import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())
