"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import pytest

from chronofold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = {c: i for i, c in enumerate(names)}
    want = Counter(tuple(plain(r[at[c]]) for c in sorted(names)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in got) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "props"]
    assert set(e.oracle_sql()) <= set(e.queries())
