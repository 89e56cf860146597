"""Importance resampling against a plain version, feature by feature."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import importance

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=2, buckets=10_000):
    w = WORD.findall((text or "").translate(UP))
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]


def brute(docs, items, longest=2, buckets=10_000, least=20, percent=25, seed=7):
    found = [(i, *features(t, longest, buckets)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for x in items:
        t.update(features(x, longest, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + buckets)) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    k = percent * len(able) // 100
    rank = {id(r): j + 1 for j, r in enumerate(able[:k])}
    return Counter((*r, rank.get(id(r))) for r in rows)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def same(spark, docs, target, **options):
    got = importance.resampled(documents(spark, docs), items(spark, target), **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    names = {"least": "least_words"}
    assert Counter(map(tuple, got.collect())) == brute(docs, target, **{k: options.get(names.get(k, k), v) for k, v in (("longest", 2), ("buckets", 10_000), ("least", 20), ("percent", 25), ("seed", 7))})


@given(st.lists(st.text(alphabet="ab Zé\n.-9\x00あ", max_size=30), max_size=8), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_buckets_of_a_batch(texts, longest):
    words, runs = importance.Features(longest, 997)([t.encode() for t in texts])
    want = [features(t, longest, 997) for t in texts]
    assert words.tolist() == [n for n, _ in want]
    got = [Counter() for _ in texts]
    for bucket, owner in runs:
        for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
            got[o][b] += 1
    assert got == [Counter(f) for _, f in want]


@given(st.binary(max_size=40), st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_a_checksum_moves_past_further_bytes(a, b):
    moved = importance.Mover()(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("options", [{}, {"longest": 1, "percent": 50}, {"longest": 3, "buckets": 50, "least_words": 1, "seed": 1}])
def test_awkward_texts(spark, options):
    words = [f"w{i}" for i in range(25)]
    docs = list(enumerate(awkward(words))) + [(50, "Ünï cödé " * 12), (50, "Ünï cödé " * 12), (None, " ".join(words)), (51, "x" * 5000 + " y")]
    same(spark, docs, [" ".join(words[:9]), None, "", "w1 w2"], **options)


def test_many_rows_of_one_text_and_ties(spark):
    docs = [(i, "the same words again and again " * 5) for i in range(300)] + [(i, f"other text number {i} " * 6) for i in range(300, 420)]
    same(spark, docs, ["the same words"])


def test_empty_tables(spark):
    nothing = documents(spark, [])
    assert importance.resampled(nothing, items(spark, ["a b"])).collect() == []
    same(spark, [(1, "word " * 30), (2, "other " * 30), (3, None), (4, "word other " * 15)], [])


def test_drawn_rows_with_clashing_columns(spark):
    docs = documents(spark, [(i, f"alpha beta gamma {i} " * 8) for i in range(40)])
    extra = docs.selectExpr("*", "1 as score", "2 as rank", "3 as weight", "'x' as text_in", "4 as drawn_id", "5 as part", "6 as id", "7 as body")
    got = importance.resample(extra, items(spark, ["alpha beta"]))
    assert got.columns == extra.columns
    want = {i for i, *_, rank in brute([(r.doc_id, r.text) for r in docs.collect()], ["alpha beta"]) if rank}
    assert {r.doc_id for r in got.collect()} == want and len(want) == 10


def test_ranks_come_from_ranges_not_from_one_task(spark):
    rows = spark.range(0, 5000, 1, 8).selectExpr("id % 7 as score", "id")
    got = importance.ranked(rows, [F.desc("score"), F.asc("id")])
    found = sorted((r["rank"], r.score, r.id) for r in got.collect())
    assert [r[0] for r in found] == list(range(1, 5001))
    assert [r[1:] for r in found] == sorted((r[1:] for r in found), key=lambda x: (-x[0], x[1]))
