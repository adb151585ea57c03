"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from graphquarry import queries as engine
from graphquarry.queries.registry import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows(data):
    return sorted(tuple(plain(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_against_duckdb(spark, duck, sf_dir, name):
    got = engine.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {names} FROM ({engine.ORACLES[name]})").fetchall()
    assert rows(got.select(*[f"`{c}`" for c in columns]).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert engine.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["query_id", "doc_id", "score", "rank"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
