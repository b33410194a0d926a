"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from oncelog.queries import QUERIES, SQL


def text(v):
    if v is None or v != v:
        return "None"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, db, name):
    out = QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    got = sorted(tuple(text(r[c]) for c in columns) for r in out.collect())
    assert got == sorted(tuple(map(text, r)) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark, sf):
    plan = QUERIES["publish_count"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan and "PushedFilters" in plan
    plan = QUERIES["effect_claim_winner"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan
