"""Boosted trees: traversal against plain recursion, held-out figures, awkward tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import awkward, by_id, documents

import __spark_entry__ as contract
from ledgerlens.llm import boosted

MID = "/root/testdata/sf0.1"
OPTIONS = {"rounds": 40, "depth": 3, "bins": 32, "rate": 0.2, "ridge": 1.0, "least": 1.0}


def walked(trees, row):
    """One row through every tree, node by node."""
    nodes, total = 2**trees.depth - 1, trees.base
    for k in range(len(trees.feature) // nodes if nodes else 0):
        at = 0
        while at < nodes:
            at = 2 * at + (2 if row[trees.feature[k * nodes + at]] > trees.threshold[k * nodes + at] else 1)
        total += trees.value[k * (nodes + 1) + at - nodes]
    return 1 / (1 + np.exp(-total))


def auc(y, s):
    kinds, which, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[which]
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_flat_traversal_is_a_walk_through_every_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = boosted.grow(x, y, **OPTIONS)
    more = rng.normal(size=(50, 5))
    assert np.allclose(boosted.traverse(trees, more), [walked(trees, r) for r in more])


def test_trees_learn_what_no_single_column_tells():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    trees = boosted.grow(x[:2500], y[:2500], **OPTIONS)
    assert ((boosted.traverse(trees, x[2500:]) >= 0.5) == y[2500:]).mean() > 0.97


def test_a_split_is_the_best_one_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (rng.random(300) < np.where(x[:, 1] > 6, 0.8, 0.2)).astype(float)
    trees = boosted.grow(x, y, rounds=1, depth=1, bins=64, rate=1.0, ridge=1.0, least=1.0)
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))

    def gain(f, t):
        left = x[:, f] <= t
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))

    best = max(((gain(f, t), -f, -t) for f in range(3) for t in np.unique(x[:, f])[:-1]))
    assert (trees.feature[0], trees.threshold[0]) == (-best[1], -best[2])


@pytest.mark.parametrize(("y", "want"), [([], 0.5), ([1.0] * 5, 1.0), ([0.0] * 5, 0.0)])
def test_labels_of_one_kind(y, want):
    trees = boosted.grow(np.zeros((len(y), 2)), np.array(y), **OPTIONS)
    assert np.allclose(boosted.traverse(trees, np.zeros((3, 2))), want, atol=1e-6)


def test_held_out_rows_are_judged_well(spark):
    got = contract.queries()["op12_quality_classifier"](spark, MID)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, s = map(np.array, zip(*held, strict=True))
    assert len(y) > 1000 and auc(y, s) > 0.98 and ((s >= 0.5) == y).mean() > 0.97


def test_held_out_labels_are_not_learnt_from(spark):
    docs = documents(spark, [(i, ("good plain words here " if i % 2 else "### $$$ ||| ") * 5) for i in range(120)])
    labels = [(i, i % 2) for i in range(120)]
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = [(i, 1 - q if i in held else q) for i, q in labels]
    tables = [spark.createDataFrame(x, "doc_id bigint, quality int") for x in (labels, flipped)]
    a, b = (by_id(boosted.classify(docs, t)) for t in tables)
    assert a == b
    assert all((a[i].score >= 0.5) == bool(i % 2) for i in range(120))


def test_awkward_tables(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(awkward(["some", "words", "in", "a", "line"]))] + [(3, "again"), (None, "no id")])
    docs = docs.selectExpr("*", "'x' as score", "1 as quality", "2 as id", "3 as label", "4 as held_out", "'y' as body")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 0), (3, 1), (4, None), (5, 7), (None, 1), (99, 0)], "doc_id bigint, quality int")
    got = boosted.classify(docs, labels, holding_out=None)
    assert got.columns == ["doc_id", "held_out", "score"]
    rows = got.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and not r.held_out for r in rows)
    assert boosted.classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in boosted.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_the_sample_is_about_its_size_and_of_any_id(spark):
    labels = spark.range(30_000).selectExpr("id", "cast(id % 2 as int) as label")
    got = [r.id for r in boosted.drawn(labels, 1000).collect()]
    assert 850 < len(got) < 1150 and 0.4 < np.mean([i < 15_000 for i in got]) < 0.6
    assert boosted.drawn(labels, 30_000).count() == 30_000


def test_statistics_of_a_text():
    text = "One TWO two!\n\nOne TWO two!\n##5 é,"
    got = dict(zip(boosted.STATISTICS, boosted.statistics(text.encode()), strict=True))
    assert np.isclose(got["log_words"], np.log1p(8)) and np.isclose(got["word_length"], 25 / 8)
    assert got["symbols"] == 2 / 8 and got["exclamations"] == 2 / 8 and got["commas"] == 1 / 8
    assert got["dup_lines"] == 1 / 3 and got["open_lines"] == 1 / 3 and np.isclose(got["variety"], 5 / 8)
    assert boosted.statistics(b"") == boosted.statistics(b" \n\t") == (0.0,) * len(boosted.STATISTICS)
