"""Every query of the core against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from terseflow.plans import queries


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_sql(spark, sf_dir, duck, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    order = sorted(rows.columns)
    found = sorted(repr([plain(r[c]) for c in order]) for r in rows.collect())
    relation = duck.sql(queries.SQL[name])
    assert sorted(relation.columns) == order
    place = [relation.columns.index(c) for c in order]
    assert found == sorted(repr([plain(r[i]) for i in place]) for r in relation.fetchall())
