"""Every registered core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vidlake.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = ordered([tuple(r) for r in found.collect()], found.columns)
    assert rows
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows == ordered(want.fetchall(), columns)
