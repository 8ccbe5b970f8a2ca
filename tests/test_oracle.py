"""Every query with an SQL twin against DuckDB on the smallest tables."""

import decimal
import math
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, int):
        return f"{x:.6g}" if abs(x) < 10**6 else str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    r = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    want = sorted([plain(row[i]) for i in order] for row in r.fetchall())
    have = sorted([plain(row[c]) for c in columns] for row in got.collect())
    close = lambda a, b: a == b or (_number(a) is not None and _number(b) is not None and math.isclose(_number(a), _number(b), rel_tol=1e-5))
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert all(map(close, a, b)), (a, b)


def _number(s):
    try:
        return float(s)
    except ValueError:
        return None


def test_queries_without_sql_give_rows(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in set(queries) - set(sql):
        if not name.startswith("op") and name != "pipeline":
            assert queries[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["dimension", "key", "n"]
