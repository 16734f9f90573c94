"""Every registered query against its SQL oracle."""

import os

import duckdb
import pytest

from brindle.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rel = con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = rel.fetchall()
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want)
    assert got or SF.endswith("sf0.001"), "no rows"
