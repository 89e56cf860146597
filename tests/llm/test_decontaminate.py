"""Decontamination against a brute-force search for every window in every text."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import awkward, by_id, documents

from ledgerlens.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = {}
    for i, text in docs:
        own = words(text)
        hit, found, longest = set(), set(), 0
        for name, test in items:
            t = words(test)
            n = min(window, len(t))
            for a in range(len(t) - n + 1 if n else 0):
                for b in range(len(own) - n + 1):
                    if own[b : b + n] == t[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(name))
                        m = n
                        while a + m < len(t) and b + m < len(own) and own[b + m] == t[a + m]:
                            m += 1
                        longest = max(longest, m)
        out[i] = (
            len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(own), longest,
        )
    return out


def texts(seed):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "7", "été", "x", "naïve", "of", "the"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(n, line(n)) for n in (1, 2, 3, 5, 6, 9, 14, 20)] + [(2, "x x"), (30, None), (31, "..."), (32, "of")]
    docs = [line(rnd.randint(0, 40)) for _ in range(25)] + awkward(["alpha", "beta", "the", "zeta"])
    docs += [f"zeta {t}, ZETA!" for _, t in items] + [f"omega {items[6][1]} omega {items[6][1]}"]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("options", [{}, {"shard_bytes": 60}, {"block_bytes": 50}])
def test_equals_brute_force(spark, seed, options):
    docs, items = texts(seed)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(d.contamination(documents(spark, docs), tests, window=4, **options))
    want = brute(list(enumerate(docs)), items, 4)
    assert {k: tuple(r)[1:] for k, r in got.items()} == want


def test_suffix_array_orders_all_words():
    rnd = np.random.default_rng(4)
    tok = rnd.integers(0, 3, 400)
    for bits in (2, 31, 62):
        sa = d.suffix_array(tok, 2, 9, bits)
        key = lambda i: tuple(tok[i : i + 9]) + (0,) * (9 - len(tok[i : i + 9]))
        assert sorted(sa.tolist()) == [i for i in range(399) if tok[i] and tok[i + 1]]
        assert all(key(a) <= key(b) for a, b in zip(sa, sa[1:], strict=False))


def test_matches_name_their_places(spark):
    item = "one two three four five six"
    docs = documents(spark, [f"zero {item} seven {item[4:]}", None])
    tests = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    found = by_id(d.report(docs, tests, ["doc_id"], window=3))[0]["found"]
    assert sorted(tuple(m) for m in found["matches"]) == [("9", 0, 1, 6), ("9", 1, 8, 5)]
    assert [list(h) for h in found["hits"]] == [[1, 7], [8, 13]]


def test_removal_keeps_clean_rows_columns_and_repeats(spark):
    item = "one two three four five six seven"
    rows = [(1, "clean text here"), (1, "clean text here"), (2, item), (None, None), (None, "found"), (3, item + " pad" * 400)]
    docs = documents(spark, rows).withColumnRenamed("lang", "found")
    tests = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    for options in ({}, {"block_bytes": 1}):
        left = d.decontaminate(docs, tests, window=5, **options)
        assert left.columns == docs.columns
        assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in left.collect()) == [
            (-1, ""), (-1, "found"), (1, "clean"), (1, "clean"), (3, "one t"),
        ]


def test_empty_tables(spark):
    none, tests = documents(spark, []).limit(0), spark.createDataFrame([], "item_id bigint, text string")
    assert d.contamination(none, tests).count() == 0
    got = by_id(d.contamination(documents(spark, ["some text"]), tests))
    assert (got[0].n_words, got[0].n_hit, got[0].contaminated) == (2, 0, False)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40}])
def test_long_repetitive_texts_and_repeated_items(spark, options):
    """A text of 20,000 equal words against an item of 400 of them, and 300 rows of one item: no pairs of all with all."""
    import time

    tests = [(1, "go " * 400), (2, "no " * 30), *[(100 + i, "one two three four five") for i in range(300)], (None, "one two three four five")]
    docs = [(1, "go " * 20_000), (2, "x " + "go " * 600 + "x"), (3, "a one two three four five b"), (4, "no " * 5000), (5, None)]
    begun = time.time()
    got = by_id(d.contamination(documents(spark, docs), spark.createDataFrame(tests, "item_id bigint, text string"), window=4, **options))
    assert time.time() - begun < 60
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].longest_match) for i in (1, 2, 3, 4, 5)] == [
        (20_000, 20_000, 1, 400), (602, 600, 1, 400), (7, 5, 301, 5), (5000, 5000, 1, 30), (0, 0, 0, 0),
    ]
    ids = sorted(["", *map(str, range(100, 400))])
    assert got[3].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_longest_matches_of_repetitive_texts_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        line = lambda n: [rnd.choice("aab") for _ in range(n)]
        items, texts_ = [line(rnd.randint(1, 9)) for _ in range(4)], [line(rnd.randint(0, 25)) for _ in range(3)]
        items = [list(x) for x in {tuple(x) for x in items}]
        t = d.test_suffixes([([str(k)], " ".join(x).encode()) for k, x in enumerate(items)], 3)
        for text, (n, hits, found, matches) in zip(texts_, d.scan([" ".join(x).encode() for x in texts_], t), strict=True):
            want = set()
            for k, x in enumerate(items):
                w = min(3, len(x))
                for a in range(len(x) - w + 1):
                    for b in range(len(text) - w + 1):
                        if x[a : a + w] == text[b : b + w] and not (a and b and x[a - 1] == text[b - 1]):
                            m = w
                            while a + m < len(x) and b + m < len(text) and x[a + m] == text[b + m]:
                                m += 1
                            want.add((str(k), a, b, m))
            assert {tuple(m.values()) for m in matches} == want and len(matches) == len(want)
            assert found == sorted({m[0] for m in want}) and n == len(text)
            assert [list(h) for h in hits] == d.united([list(h) for h in hits])


def test_no_text_is_shuffled_and_the_driver_reads_no_item(spark):
    docs = documents(spark, ["some text here", "other"])
    tests = spark.createDataFrame([(i, f"item number {i} of many") for i in range(20)], "item_id bigint, text string")
    plan = d.report(docs, tests, docs.columns, window=3, block_bytes=30)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "HashAggregate" not in plan
    assert plan.count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
