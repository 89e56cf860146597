"""The registered queries against their SQL (DuckDB) or a brute-force version on whole small tables, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest
from helpers import by_id
from test_simhash import brute as near_brute
from test_suffixdedup import brute as substring_brute

import __spark_entry__ as contract
import corpus_pipeline
from ledgerlens.llm import queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(queries.SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    rel = con.sql(queries.SQL[name])
    df = contract.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    want = sorted(tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall())
    assert got == want and len(got) > 0


def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates_of_the_whole_table(spark):
    got = by_id(contract.queries()["op2_simhash"](spark, SMALL))
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == near_brute(rows(spark, SMALL))


def test_repeats_of_the_whole_table(spark):
    got = by_id(contract.queries()["op4_suffix_dedup"](spark, SMALL))
    assert {k: tuple(r)[1:] for k, r in got.items()} == substring_brute(rows(spark, SMALL), 400)


def test_pipeline_against_a_plain_version(spark):
    """Language id keeps every document of these tables with a letter; the other stages one by one."""
    import hashlib

    from test_decontaminate import brute as contamination
    from test_linededup import brute as _  # noqa: F401
    from test_linededup import key
    from tokenizers import Tokenizer

    docs = [(i, t) for i, t in rows(spark, SMALL) if any(c.isalpha() for c in t or "")]
    first = {}
    for i, text in docs:
        for line in text.split("\n"):
            first[key(line)] = min(first.get(key(line), i), i)
    docs = [(i, "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or first[key(x)] == i)) for i, text in docs]
    near = near_brute(docs)
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = contamination(docs, items, 13)
    docs = [(i, t) for i, t in docs if not found[i][4]]
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = by_id(contract.queries()["pipeline"](spark, SMALL))
    assert {k: tuple(r)[1:] for k, r in got.items()} == want
    assert 0 < len(want) < 200


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    from ledgerlens.plans.catalog import QUERIES

    gone = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("ledgerlens.llm")]
    for m in [*gone, "corpus_pipeline", "ledgerlens.llm"]:
        monkeypatch.setitem(sys.modules, m, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(QUERIES) == set(alone.oracle_sql())
    monkeypatch.undo()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    """No documents: every stage runs and gives none."""
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.collect() == []
