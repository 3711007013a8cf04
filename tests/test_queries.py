"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillgraph.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def tidy(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = tidy(map(tuple, df.select(*cols).collect()))
    assert name in registry.ORACLES
    assert got == tidy(con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall())


def test_queries_only_use_their_columns(spark, sf):
    plan = registry.QUERIES["token_cost"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan
