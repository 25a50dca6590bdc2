"""Driver contract: entry() runs; every query matches its DuckDB oracle on sf0.001."""

import datetime as dt
import decimal
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from skywatch.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "title", "kind", "line"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


BATCH = [k for k in QUERIES if k not in ("login_stream", "device_stream")]  # streams: test_streaming.py


@pytest.mark.parametrize("name", BATCH)
def test_query_matches_oracle(spark, con, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    assert got == want
