"""Every registered query of the engine against its DuckDB SQL, and the contract's three functions."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from lamina.plans.oracles import ORACLES
from lamina.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def compare(spark, sf_dir, make, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = make(spark, sf_dir), con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in columns]
    rows = sorted(tuple(map(normal, r)) for r in found.select(*columns).collect())
    assert rows == sorted(tuple(normal(r[i]) for i in place) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    compare(spark, small, QUERIES[name], ORACLES[name])


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
