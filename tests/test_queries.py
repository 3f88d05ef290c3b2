"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from callgauge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, int | float):
        return str(v)
    return repr(float(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_is_its_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = duck.execute(registry.sql()[name])
    columns = [c[0] for c in got.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(registry.sql())):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name
