"""Every query with SQL, run in both engines over the smallest tables; as the driver does, values are compared without order."""

import math
import os

import duckdb
import pytest

from tracewright.plans import registry

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    a = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    b = sorted(str(tuple(plain(r[rel.columns.index(c)]) for c in cols)) for r in rel.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
