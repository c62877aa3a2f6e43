"""Every query against the same query in DuckDB, on the same files."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def _text(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(_text(x) for x in v) + "]"
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    if isinstance(v, (int, np.integer)):
        return repr(int(v))
    return str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_text(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "query_id" and df.count() > 0
