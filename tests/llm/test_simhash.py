"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from helpers import awkward, by_id, documents
from pyspark.sql import functions as F

from ledgerlens.llm import simhash as s
from ledgerlens.llm.components import components


def fingerprint(text, size):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))] if own else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, size=4, distance=4):
    fp = {i: fingerprint(t, size) for i, t in rows}
    group = {i: i for i in fp}
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= distance and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i: (format(fp[i], "016x"), group[i]) for i in fp}


def near_texts(seed, n=40):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(120)] for _ in range(6)]
    out = []
    for _ in range(n):
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            own[rnd.randrange(len(own))] = "changed"
        out.append(" ".join(own))
    return out + awkward(["one", "two", "three", "four", "five"])


@pytest.mark.parametrize("run_limit", [1 << 20, 2])
def test_equals_all_pairs(spark, run_limit):
    rows = list(enumerate(near_texts(1)))
    got = by_id(s.near_duplicates(documents(spark, rows), run_limit=run_limit))
    want = brute(rows)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == want
    assert 6 < len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5, 7])
def test_near_fingerprints_share_a_variant(distance):
    rnd = random.Random(distance)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, distance)):
            b ^= 1 << bit
        masks = s.one_wildcard(0, distance)
        shared = [m for m in masks if a & m == b & m]
        assert shared
        assert any(a & m == b & m for m in s.one_wildcard(shared[0], distance))  # and a finer one of that


@pytest.mark.parametrize("seed", range(3))
def test_links_of_a_run_join_it_up(seed):
    rnd = np.random.default_rng(seed)
    fps = np.unique(rnd.integers(0, 2**10, 200) - 2**62)  # high bits set: signed numbers
    links = list(s.run_links(fps, 1))
    assert len(links) < len(fps)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 1 for a, b in links)
    group = {int(f): int(f) for f in fps}
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    for a in group:
        for bit in range(10):
            if (a ^ 1 << bit) in group:
                assert group[a] == group[a ^ 1 << bit]


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text + " end"), (3, text + " end"), (None, text), (None, "alone one"), (None, "other two"), (7, ""), (8, None)]
    docs = documents(spark, rows).withColumnRenamed("source", "fp")
    left = s.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:9]) for r in left.collect())
    assert got == [(-1, "alone one"), (-1, "other two"), (3, text[:9]), (7, "")]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def test_empty_table(spark):
    assert s.near_duplicates(documents(spark, []).limit(0)).count() == 0
    assert s.drop_near_duplicates(documents(spark, []).limit(0)).count() == 0
    assert s.fingerprints(documents(spark, ["a b"]), ["doc_id"]).select(F.col("fp")).count() == 1


def test_long_runs_are_refined_at_the_default(spark):
    """6,000 classes that share a segment, so more than a run may have: components equal those of all pairs."""
    rnd = np.random.default_rng(3)
    shared = np.uint64(0x1ABCD)
    fps = (rnd.integers(0, 1 << 42, 5000).astype(np.uint64) << np.uint64(22)) | shared
    near = fps[:1000] ^ (np.uint64(1) << rnd.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 1000).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near]))
    signed = fps.view(np.int64)
    assert len(fps) > s.RUN_LIMIT
    up = {int(x): int(x) for x in signed}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4):
            a, b = root(int(signed[i])), root(int(signed[j]))
            up[max(a, b)] = min(a, b)
    classes = spark.createDataFrame([(int(x),) for x in signed], "fp bigint")
    links = [(r.a, r.b) for r in s.variant_links(classes, 4, s.RUN_LIMIT).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    own = {int(x): int(x) for x in signed}
    want = {x: root(x) for x in up}
    up = own
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {x: root(x) for x in up} == want and 900 < len(set(want)) - len(set(want.values()))


def test_tables_of_earlier_steps_are_removed(spark):
    import os

    from ledgerlens.llm.common import shared_folder, store

    rows = list(enumerate(near_texts(1)))
    root = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = store(s.near_duplicates(documents(spark, rows)), "result")
    left = [x for x in set(os.listdir(root)) - before if x.startswith("links-")]
    assert len(left) == 1 and got.count() == len(rows)
