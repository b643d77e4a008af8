import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagewarden.plans import queries as own

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    r = duck.execute(own.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(rounded(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall()), key=repr)
    assert sorted((tuple(rounded(row[c]) for c in sorted(names)) for row in df.collect()), key=repr) == want


def test_every_query_has_sql_or_is_a_numbered_operator():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(n.startswith("op") or n == "pipeline" for n in set(entry.queries()) - set(entry.oracle_sql()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
