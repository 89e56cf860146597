"""Substring deduplication against a table of all strings of that length."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, by_id, documents
from pyspark.sql import functions as F

from ledgerlens.llm import induced
from ledgerlens.llm import suffixdedup as s


def brute(rows, n):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k + 1 : k + n + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 30)))
    shared = [word() * 2 for _ in range(5)]
    out = ["".join(rnd.choice([*shared, word(), word()]) for _ in range(rnd.randint(0, 8))) for _ in range(40)]
    return out + ["ab" * 50, "a" * 70, "a" * 15, out[3], out[3], out[4] + "tail"] + awkward(["words of a line", "and others"])


@pytest.mark.parametrize("options", [{}, {"hot_pieces": 1}, {"shard_bytes": 40, "memory": 0}])
@pytest.mark.parametrize("n,gram", [(12, 4), (16, 16)])
def test_equals_brute_force(spark, options, n, gram):
    rows = list(enumerate(texts(n)))
    got = by_id(s.substring_report(documents(spark, rows), length=n, gram=gram, **options))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute(rows, n)


@pytest.mark.parametrize("stretch", [1, 3])
def test_narrowing_changes_nothing(spark, monkeypatch, stretch):
    monkeypatch.setattr(s, "STRETCH", stretch)  # shipped with the job, as all of the package is
    rows = list(enumerate(texts(31)))
    got = by_id(s.substring_report(documents(spark, rows), length=16, gram=5))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute(rows, 16)


def test_narrowed_pieces():
    piece = lambda i, text, at, many=False: (many, i, 0, 0, at, text)
    a, b = b"xxxxGRAMaaaa", b"yyyyGRAMaaaa"
    sort, known = s.narrowed([piece(1, a, 4), piece(2, b, 4)], 8, 4)
    # The windows that share "GRAM" alone are one stretch: its texts differ, so both are sorted.
    assert sorted(sort) == [(False, 1, 0, 0, a), (False, 2, 0, 0, b)] and known == []
    sort, known = s.narrowed([piece(1, b"GRAMaaaa", 0), piece(2, b"GRAMaaaa", 0), piece(3, b"GRAMbbbb", 0, True)], 8, 4)
    assert known == [(1, 0, 0, 1), (2, 0, 0, 1)]
    assert s.narrowed([piece(1, a, -1), piece(2, b, 4)], 8, 4) == ([(False, 1, 0, 0, a), (False, 2, 0, 0, b)], [])


def test_slices_of_a_long_text_change_nothing(monkeypatch):
    rnd = random.Random(2)
    data = np.frombuffer("".join(rnd.choice("ab") for _ in range(900)).encode() + b"c" * 100, np.uint8)
    ends = np.array([0, 300, 300, 305, 1000])

    def windows():
        return {
            (int(k), int(a) + i): int(t)
            for key, first, n, gram_at in s.pieces(data, ends, s.Grams(5), 20)
            for k, a, m, t in zip(key, first, n, gram_at, strict=True)
            for i in range(m)
        }

    whole = windows()
    assert sorted(at for _, at in whole) == [*range(281), *range(305, 981)]
    monkeypatch.setattr(s, "SLICE", 37)
    assert windows().keys() == whole.keys()


@pytest.mark.parametrize("batch", [1 << 18, 1, 5])
@pytest.mark.parametrize("alphabet,small", [(4096, 1 << 16), (4096, 0), (3, 0), (3, 12)])
def test_suffixes_and_common_prefixes(monkeypatch, alphabet, small, batch):
    monkeypatch.setattr(induced, "BATCH", batch)
    monkeypatch.setattr(induced, "ALPHABET", alphabet)
    monkeypatch.setattr(induced, "SMALL", small)
    rnd = random.Random(alphabet + small)
    for _ in range(250):
        t = [rnd.randint(1, rnd.choice([1, 2, 5, 20])) for _ in range(rnd.randint(0, 50))]
        t = np.array(t * rnd.choice([1, 1, 3]) + [0], np.int64)
        cap = rnd.choice([4, 400])
        order, shared = induced.sort_suffixes(t, cap, induced.Scratch(rnd.choice([0, 1 << 20])))
        text = t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        for k, (a, b) in enumerate(zip(want, want[1:], strict=False), 1):
            n = 0
            while n < cap and text[a + n] == text[b + n]:
                n += 1
            assert shared[k] == n


def test_removal_keeps_rows_and_columns(spark):
    passage = "a passage that is long enough to count "
    rows = [(1, passage + "one"), (2, "two " + passage), (2, "two " + passage), (None, None), (3, "short")]
    docs = documents(spark, rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "key")
    out = s.remove_repeats(docs, length=20, gram=8)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, ""), (1, "one"), (2, ""), (2, ""), (3, "short")]


def test_empty_table(spark):
    assert s.substring_report(documents(spark, []).limit(0)).count() == 0


def periodic(seed=3):
    """Long texts of few periods and of different lengths, alone, within other text, with a flaw, and twice over."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    out = [("0," * 9000)[:n] for n in (40, 3000, 3001, 7777, 12000)]
    out += [word(30) + "=" * n + word(30) for n in (15, 2000, 5000)]
    out += [("a line\n" * 900)[k:] + word(20) for k in range(4)]
    return out + ["0," * 2000 + "!" + "0," * 1000, "xyz" * 8, "-" * 12, "-" * 11, out[1], word(400)]


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 0}, {"hot_bytes": 9000}])
@pytest.mark.parametrize("rows_", [1 << 14, 7])
def test_periodic_texts_equal_brute_force(spark, monkeypatch, options, rows_):
    monkeypatch.setattr(s, "ROWS", rows_)
    rows = list(enumerate(periodic()))
    got = by_id(s.substring_report(documents(spark, rows), length=12, gram=4, **options))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute(rows, 12)


def test_no_task_gets_a_key_of_many_bytes(spark, monkeypatch):
    """Pieces of one period and different lengths share a key: it is cut to the few windows of its period."""
    rows = [(i, "0123456789" * (5000 + i) + "x" * i) for i in range(12)]
    seen = {}
    sort = s.sorted_shards

    def spy(cut, *args):
        sizes = cut.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size")).collect()
        seen["most"] = max((r["size"] or 0 for r in sizes), default=0)
        return sort(cut, *args)

    cut_out = s.cut_out
    monkeypatch.setattr(s, "sorted_shards", spy)
    monkeypatch.setattr(s, "cut_out", lambda *a: seen.setdefault("cut", cut_out(*a)))
    got = by_id(s.substring_report(documents(spark, rows), length=20, gram=5, hot_bytes=100_000))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute(rows, 20)
    assert seen["most"] <= 100_000
    assert seen["cut"].count() < 12 * 100


@pytest.mark.parametrize("hot", [1, 5, 30])
def test_a_passage_of_many_documents_goes_to_no_single_task(spark, monkeypatch, hot):
    """Parts of one passage, of many lengths, between texts of their own, some documents twice: pieces of the
    same keys. None of a key with many pieces is sorted, and results equal brute force."""
    rnd = random.Random(hot)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    passage = word(90)
    texts = [word(rnd.randint(0, 30)) + passage[rnd.randint(0, 40) : rnd.randint(50, 90)] + word(rnd.randint(0, 30)) for _ in range(80)]
    rows = list(enumerate(texts + texts[:8]))
    seen = []
    sort = s.sorted_shards
    monkeypatch.setattr(s, "STRETCH", 3)
    monkeypatch.setattr(s, "sorted_shards", lambda cut, *args: (seen.append(cut), sort(cut, *args))[1])
    got = by_id(s.substring_report(documents(spark, rows), length=20, gram=5, hot_pieces=hot))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute(rows, 20)
    assert max((r["count"] for r in seen[0].groupBy("key").count().collect()), default=0) <= hot


def test_a_string_larger_than_memory_is_sorted_in_batches(monkeypatch):
    """Long arrays are files, batches are small: of a string that takes 60 MB of arrays a sixth is in memory at once."""
    import tracemalloc

    monkeypatch.setattr(induced, "BATCH", 1 << 14)
    rnd = np.random.default_rng(1)
    passage = rnd.integers(2, 60, 40_000)
    parts = [x for _ in range(12) for x in (passage[: rnd.integers(20_000, 40_000)], rnd.integers(2, 60, 60_000))]
    body = np.concatenate(parts)
    scratch = induced.Scratch(1 << 16)
    t = scratch.array(len(body) + 2, np.uint16)
    t[:-2], t[-2], t[-1] = body, 1, 0
    assert isinstance(t, np.memmap)
    tracemalloc.start()
    order, shared = induced.sort_suffixes(t, 400, scratch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(order, np.memmap) and isinstance(shared, np.memmap)
    assert len(t) > 900_000 and peak < 12 << 20
    plain_order, plain_shared = induced.sort_suffixes(np.array(t), 400)
    assert np.array_equal(order, plain_order) and np.array_equal(shared, plain_shared)
    assert (np.asarray(shared) == 400).sum() > 200_000
