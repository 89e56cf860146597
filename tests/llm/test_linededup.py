"""Line deduplication against a plain walk through all lines."""

from __future__ import annotations

import hashlib
import random

import pytest
from helpers import awkward, by_id, documents

from ledgerlens.llm import linededup as d

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least=10):
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("salts", [1, 3, 1024])
def test_equals_brute_force(spark, salts):
    rnd = random.Random(salts)
    pool = ["short", "A line of some length", " a LINE of some length\t", "été à la ligne ÉTÉ", "\x0btabbed and fed\x0c", "", "  ", "0123456789", "012345678"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))) for _ in range(40)]
    texts += awkward(["lines of words", "and more of them"]) + ["A line of some length"] * 5
    rows = list(enumerate(texts))
    got = by_id(d.line_report(documents(spark, rows), salts=salts))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute(rows)


def test_bitmaps_are_runs(spark):
    docs = documents(spark, [(1, "same line of text\nother line here\nthird line there"), (2, "x\nsame line of text\nother line here\ny\nthird line there")])
    got = {r.id: [tuple(x) for x in r.drops] for r in d.keep_bitmaps(docs).collect()}
    assert got == {2: [(1, 2), (4, 1)]}


def test_columns_nulls_and_repeats(spark):
    rows = [(2, "a line that is shared\nown two"), (1, "a line that is shared"), (1, "a line that is shared"), (None, "a line that is shared\nnull id"), (3, None)]
    docs = documents(spark, rows).withColumnRenamed("lang", "drops").withColumnRenamed("source", "pos")
    out = d.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.filter("doc_id <> 3 or doc_id is null").collect())
    # A null id comes before all others, so its line is the first.
    assert got == [(-1, "a line that is shared\nnull id"), (1, ""), (1, ""), (2, "own two")]
    assert by_id(out)[3].text is None
    assert by_id(d.line_report(docs))[3].n_lines == 1


def test_empty_table(spark):
    assert d.line_report(documents(spark, []).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = d.line_report(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
