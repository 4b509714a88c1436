"""Every registered query of the catalogue against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import velum.plans.documents  # noqa: F401
import velum.plans.values  # noqa: F401
from velum.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str | int):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [[plain(x[c]) for c in columns] for x in df.collect()]
    if name not in ORACLE_SQL:
        assert columns
        return
    cur = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = [[plain(x[names.index(c)]) for c in columns] for x in cur.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
