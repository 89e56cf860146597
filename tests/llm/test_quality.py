"""Quality: counts against a plain version, estimation on drawn votes, verdicts against held-out labels."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, by_id, documents
from pyspark.sql import functions as F

from ledgerlens.llm import quality as q

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in text).split("\n") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def texts():
    rnd = random.Random(1)
    out = [" ".join(rnd.choice(["a", "b", "É#", "ab\xa0c"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    return out + awkward(["one", "two", "<three>"]) + ["a b c\na b c\n \na b c", "a\x0bb\x0cc\rd", "\x85 x", "é" * 5000]


def test_counts_equal_the_plain_version(spark):
    got = by_id(q.text_counts(documents(spark, texts()), ["doc_id"]))
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: plain(t) for i, t in enumerate(texts())}


def test_many_kinds_of_words_take_the_other_path():
    ids = np.array([0, 1, 2, 5, 0, 1, 2], np.int64)
    assert q.repeated_words(ids, 6) == q.repeated_words(ids, 1 << 21) == 6


def test_two_kinds_of_bad_texts_and_a_rule_that_looks_for_neither():
    rnd = np.random.default_rng(3)
    good = rnd.random(20_000) < 0.8
    kind = rnd.integers(0, 2, 20_000)
    vote = lambda p: np.where(rnd.random(20_000) < p, -1, 1)
    votes = np.stack([vote(np.where(~good & (kind == 0), 0.95, 0.01)), vote(np.where(~good & (kind == 1), 0.95, 0.01)), vote(0.01)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p = dict(zip(map(tuple, patterns.tolist()), q.estimate(patterns, n.astype(float))["posterior"], strict=True))
    assert p[-1, 1, 1] < 0.5 and p[1, -1, 1] < 0.5 and p[1, 1, 1] > 0.9


def test_abstaining_is_no_vote_but_of_its_own_kind():
    """A text that all rules abstain on is as good as the kinds' shares and the rules' misses say."""
    made = q.estimate(np.array([[1, 1], [0, 0], [-1, 1]]), np.array([90.0, 10.0, 5.0]))
    share, rates = made["share"], made["rates"]
    missed = [share[1] * (1 - rates[1, 0]), share[2] * (1 - rates[2, 1])]
    assert made["posterior"][1] == pytest.approx(share[0] / (share[0] + sum(missed)), abs=0.01)


def drawn(seed, n, shares, rates, abstain=0.1):
    """Vote patterns of texts of planted kinds, whose rules say bad at planted rates."""
    rnd = np.random.default_rng(seed)
    kind = rnd.choice(len(shares), n, p=shares)
    votes = np.where(rnd.random((n, rates.shape[1])) < rates[kind], -1, 1)
    votes[rnd.random(votes.shape) < abstain] = 0
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return kind, patterns, at.ravel(), count.astype(float)


@pytest.mark.parametrize("n", [20_000, 400_000])
def test_planted_accuracies_of_a_rare_bad_kind_are_recovered(n):
    """Kinds of 2, 6 and 4 % that two or three rules catch, each at its own rate."""
    shares = np.array([0.88, 0.02, 0.06, 0.04])
    rates = np.full((4, 8), 0.005)
    rates[0] = [0.004, 0.01, 0.006, 0.002, 0.008, 0.003, 0.005, 0.009]
    rates[1, :3], rates[2, 3:5], rates[3, 5:7] = [0.9, 0.8, 0.7], [0.95, 0.6], [0.9, 0.5]
    kind, patterns, at, count = drawn(4, n, shares, rates, abstain=0.0)
    made = q.estimate(patterns, count)
    assert abs(made["share"][0] - 0.88) < 0.03 and np.abs(made["rates"][0] - rates[0]).max() < 0.01
    for planted, share in zip(rates[1:], shares[1:], strict=True):
        off = np.abs(made["rates"][1:] - planted).max(1)  # a kind may stand under any rule that catches it
        assert off.min() < 0.1 and abs(made["share"][1 + off.argmin()] - share) < 0.01
    assert ((made["posterior"] >= 0.5)[at] == (kind == 0)).mean() > 0.95


def test_what_is_estimated_decides():
    """Rule 1 never fires alone but on its own texts; rule 2 misses half of its kind, which rule 0 catches."""
    shares = np.array([0.8, 0.1, 0.0, 0.1])
    rates = np.array([[0.001, 0.015, 0.001], [0.99, 0.01, 0.01], [0.5, 0.5, 0.5], [0.01, 0.01, 0.6]])
    kind, patterns, at, count = drawn(5, 50_000, shares, rates)
    first, last = (q.estimate(patterns, count, steps=k)["posterior"] for k in (1, 3000))
    right = [((p >= 0.5)[at] == (kind == 0)).mean() for p in (first, last)]
    assert right[1] > right[0] and ((first >= 0.5) != (last >= 0.5))[at].mean() > 0.005


def test_verdicts_of_a_whole_table_depend_on_what_is_estimated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, last = (by_id(q.judged(docs, ["doc_id"], steps=k)) for k in (1, 3000))
    changed = [i for i, r in last.items() if r.good != first[i].good]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [[bool(rows[i].good) == bool(labels[i]) for i in changed if i in labels] for rows in (first, last)]
    assert len(changed) >= 20 and sum(right[1]) > sum(right[0])


def test_names_that_clash_stay(spark):
    docs = documents(spark, ["some words " * 40, None]).selectExpr("doc_id", "text", "'mine' as p_good", "1 as good", "2 as n_words")
    got = q.judged(docs, ["doc_id", "p_good", "good", "n_words"])
    assert len(set(got.columns)) == len(got.columns) and {"_p_good", "_good", "_n_words"} <= set(got.columns)
    assert {(r.p_good, r.good, r.n_words) for r in got.collect()} == {("mine", 1, 2)}


def test_labelled_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.judged(docs, ["doc_id"]).withColumn("failed", q.base_failed()).filter("not failed").join(labels, "doc_id")
    shares = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.995 and shares[0] < 0.2


def test_awkward_tables(spark):
    assert q.judged(documents(spark, []).limit(0), ["doc_id"]).count() == 0
    docs = documents(spark, awkward(["some", "words"])).withColumnRenamed("n_chars", "p_good")
    got = q.judged(docs.drop("p_good"), ["doc_id", "lang"]).collect()
    assert len(got) == docs.count() and all(0 <= r.p_good <= 1 for r in got)
