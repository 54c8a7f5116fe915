"""Every query with an oracle gives the oracle's rows; the others give rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rippletrace.jobs import queries as jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(frame):
    """Rows as sorted texts; what is missing may be None, NaN or the NA of nullable columns."""
    rows = frame[sorted(frame.columns)].astype(object).to_numpy().tolist()
    missing = lambda v: v is None or v is pd.NA or v != v
    return sorted(tuple("-" if missing(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = jobs.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if name in jobs.ORACLES:
        expected = duck.execute(jobs.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert plain(found) == plain(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
