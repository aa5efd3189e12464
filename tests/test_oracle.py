"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{tiny}/{f}')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "~" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else str(v)
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, tiny, duck):
    assert plain(QUERIES[name](spark, tiny).toPandas()) == plain(duck.execute(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_runs_on_empty_tables(spark, tiny, tmp_path):
    import variants

    d = variants.write(tiny, str(tmp_path), variants.empty)
    for name, q in QUERIES.items():
        q(spark, d).count()


def test_station_queries_run_on_odd_tables(spark, tiny, tmp_path):
    """Rows of NULLs, repeated rows and extra columns at once; the pN_ queries have tests of their own."""
    import variants

    odd = lambda name, t: variants.repeated(name, variants.with_clashes(name, variants.with_null_rows(name, t)))
    d = variants.write(tiny, str(tmp_path), odd)
    for name, q in QUERIES.items():
        if not (name[0] == "p" and name[1].isdigit()):
            df = q(spark, d)
            assert df.columns == q(spark, tiny).columns, name
            df.count()


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["scan_history"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ingest_date), GreaterThanOrEqual(ingest_date" in plan
    plan = QUERIES["scan_projected"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<station_id:bigint,ts:timestamp_ntz,bikes:double>" in plan
