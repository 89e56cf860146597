"""The driver's correctness gate, locally: each registered query against its
DuckDB SQL at sf0.01 — same columns, types, row count and values."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
RAW = "region nation customer supplier part orders lineitem".split()
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in RAW:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = contract.queries()[name](spark, SF)
    got = df.collect()
    rel = con.sql(contract.oracle_sql()[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for c in df.columns:
        assert DUCK_TYPES.get(spark_types[c], spark_types[c].upper()) == duck_types[c], c
    order = sorted(df.columns)
    a = sorted(tuple(repr(r[c]) for c in order) for r in got)
    idx = [rel.columns.index(c) for c in order]
    b = sorted(tuple(repr(r[i]) for i in idx) for r in want)
    assert len(a) == len(b)
    assert a == b
