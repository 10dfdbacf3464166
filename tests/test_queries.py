"""Registered queries against their SQL over the smallest tables."""

import math
import os

import duckdb
import pytest

from radiantlake import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, str):
        return v
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)))


def test_flagship(spark, small):
    assert os.path.isdir(small)
    assert catalog.flagship(spark, small).count() == 10
