"""Every registered query of the engine against its SQL on DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"]
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == cols
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes if k in KINDS} == {c: kinds[c] for c, k in df.dtypes if k in KINDS}
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
