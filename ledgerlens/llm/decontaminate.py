"""Benchmark decontamination by training suffix arrays.

The training texts are cut into shards of whole documents. Each task builds
a suffix array over the words of its shard and binary-searches every suffix
of every test item in it: the range at window depth gives all occurrences of
that window, and stepping on past it gives the longest verbatim match. A
document lies in one shard, so nothing is shuffled and a hot source or a
passage that a third of all documents share stays spread over all tasks.

Only suffixes that a test window can match are sorted: those followed by at
least the shortest window's number of words of the test vocabulary. This
leaves out nothing that could be found. Suffixes are ordered to the depth of
the longest test item, as no test suffix can look deeper.

Test items of equal text are one item with a list of ids. They are cut into blocks of
about ``block_bytes`` of text by Spark, and tasks number each block's words and list its suffixes;
the blocks are files in the shared folder that every executor fetches. A task takes
its shard through all blocks, one after the other in its memory, and joins up what they find, so texts are
read once and never shuffled, and the driver holds no item.

Ranges of windows of one length are equal or disjoint, so they are marked in difference
arrays and looked at once each, however often a text or an item repeats itself. Of the longest
matches only those that begin there are made: pairs whose words before differ.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, so
they can be told from bytes alone. Null and empty texts have no words and are
clean. A null item id counts as the empty string. Rows that repeat (same
id and text) get the same result each. A longest match with items of equal text names the
least of their ids.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, fresh, map_texts, store

WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)

MATCH = T.StructType(
    [T.StructField(n, t) for n, t in (("item_id", T.StringType()), ("item_word", T.LongType()), ("doc_word", T.LongType()), ("n_words", T.LongType()))]
)
REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("matches", T.ArrayType(MATCH)),
    ]
)


class TestSuffixes(NamedTuple):
    """One block of test items, their words numbered from 1 (0: any other word)."""

    vocabulary: dict[bytes, int]
    ids: list[list[str]]  # of each item, sorted
    words: np.ndarray  # of all items, a 0 after each
    start: np.ndarray  # of each suffix that is long enough for a window
    left: np.ndarray  # words from there to the item's end
    item: np.ndarray
    first: np.ndarray  # where the item starts
    window: np.ndarray  # its window's length


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def test_suffixes(items: list[tuple[list[str], bytes]], window: int) -> TestSuffixes:
    vocabulary: dict[bytes, int] = {}
    words: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    ids: list[list[str]] = []
    for names, text in items:
        own = split_words(text)
        if not own:
            continue
        at, size = len(words), min(window, len(own))
        words += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own] + [0]
        rows += [(at + i, len(own) - i, len(ids), at, size) for i in range(len(own) - size + 1)]
        ids.append(sorted(names))
    start, left, item, first, size = np.array(rows, np.int64).reshape(-1, 5).T
    return TestSuffixes(vocabulary, ids, np.array(words, np.int64), start, left, item, first, size)


def suffix_array(tok: np.ndarray, least: int, depth: int, bits: int) -> np.ndarray:
    """Positions followed by ``least`` known words, in the order of their next ``depth`` words.

    Sorted by as many words as a long holds, then tied suffixes by the next ones.
    """
    n = len(tok)
    stops = np.append(np.flatnonzero(tok == 0), n)
    at = np.arange(n)
    sa = at[stops[np.searchsorted(stops, at)] - at >= least]
    per = max(1, 62 // bits)
    padded = np.concatenate([tok, np.zeros(depth + per + 1, tok.dtype)])

    def key(pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), np.int64)
        for j in range(per):
            out = (out << bits) | padded[np.minimum(pos + j, n + depth)]
        return out

    if not len(sa):
        return sa
    k = key(sa)
    order = np.argsort(k, kind="stable")
    sa, k = sa[order], k[order]
    group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
    for d in range(per, depth, per):
        tied = np.zeros(len(sa), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        k = key(sa[where] + d)
        order = np.lexsort((k, group[where]))
        sa[where] = sa[where][order]
        g, k = group[where], k[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        step = np.zeros(len(sa), np.int64)
        step[where] = new
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(np.maximum(step, starts & ~tied)) - 1
    return sa


def search(sa: np.ndarray, tok: np.ndarray, t: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix: the range of the suffix array that starts with its window, and its longest match in words."""
    lo, hi = np.zeros(len(t.start), np.int64), np.full(len(t.start), len(sa), np.int64)
    at_lo, at_hi, longest = lo.copy(), lo.copy(), np.zeros(len(t.start), np.int64)
    padded = np.append(tok, np.zeros(int(t.left.max(initial=0)) + 1, tok.dtype))
    on, d = np.arange(len(t.start)) if len(sa) else np.arange(0), 0

    def bound(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """First place in [a, b) whose word at depth ``d`` is q or more."""
        a, b = a.copy(), b.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = padded[sa[np.minimum(mid, len(sa) - 1)] + d] < q
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    while len(on):
        q = t.words[t.start[on] + d]
        lo[on], hi[on] = bound(lo[on], hi[on], q), bound(lo[on], hi[on], q + 1)
        on = on[lo[on] < hi[on]]
        d += 1
        longest[on] = d
        full = on[t.window[on] == d]
        at_lo[full], at_hi[full] = lo[full], hi[full]
        on = on[t.left[on] > d]
    return at_lo, at_hi, longest


class Ranges(NamedTuple):
    """The different ranges of the suffix array that test windows have, and the suffixes of each."""

    lo: np.ndarray
    hi: np.ndarray
    window: np.ndarray
    suffix: np.ndarray  # test suffixes, range by range
    cut: np.ndarray  # where each range's suffixes begin


def different(lo: np.ndarray, hi: np.ndarray, t: TestSuffixes) -> Ranges:
    found = np.flatnonzero(hi > lo)
    key = np.stack([t.window[found], lo[found]], 1)  # ranges of one window length are equal or disjoint
    kinds, first, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    cut = np.searchsorted(which.ravel()[order], np.arange(len(kinds) + 1))
    return Ranges(lo[found][first], hi[found][first], kinds[:, 0], found[order], cut)


def covered(r: Ranges, sa: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in any occurrence of a window."""
    cover = np.zeros(n + 1, np.int64)
    for w in np.unique(r.window).tolist():
        own = r.window == w
        inside = np.zeros(len(sa) + 1, np.int64)
        np.add.at(inside, r.lo[own], 1)
        np.add.at(inside, r.hi[own], -1)
        pos = sa[np.cumsum(inside)[:-1] > 0]
        cover[pos] += 1
        np.add.at(cover, pos + w, -1)
    return np.cumsum(cover)[:n] > 0


def begins(places: np.ndarray, suffixes: np.ndarray, before_place: np.ndarray, before_suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a range's places and suffixes but those with the same word (from 0 on) before them.

    -1: nothing stands before, or no test word. Made group by group, so that only pairs that are given back cost anything.
    """
    groups = np.argsort(before_suffix, kind="stable")
    kinds, start = np.unique(before_suffix[groups], return_index=True)
    out_p, out_s = [], []
    for k, own in zip(kinds.tolist(), np.split(groups, start[1:]), strict=True):
        free = places if k < 0 else places[before_place != k]
        out_p.append(np.repeat(free, len(own)))
        out_s.append(np.tile(suffixes[own], len(free)))
    return np.concatenate(out_p), np.concatenate(out_s)


def scan(texts: list[bytes], t: TestSuffixes) -> list[tuple[int, list, list, list]]:
    """Of each text: its words, the runs of hit words, the items found, and the longest matches with their places."""
    get = t.vocabulary.get
    parts: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = split_words(text)
        sizes[i] = len(own)
        parts.append(np.fromiter((get(w, 0) for w in own), np.int64, len(own)))
        parts.append(np.zeros(1, np.int64))
    tok = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    out: list[tuple[int, list, list, list]] = [(int(n), [], [], []) for n in sizes]
    if not len(t.start):
        return out
    sa = suffix_array(tok, int(t.window.min()), int(t.left.max()), max(1, int(len(t.vocabulary)).bit_length()))
    lo, hi, _ = search(sa, tok, t)
    r = different(lo, hi, t)
    if not len(r.lo):
        return out
    edge = np.diff(np.concatenate([[0], covered(r, sa, len(tok)).astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(first, a, "right") - 1
    for d, x, y in zip(owner.tolist(), (a - first[owner]).tolist(), (b - first[owner]).tolist(), strict=True):
        out[d][1].append([x, y])
    # Ranges of the same items are one: windows of a passage have the same.
    items: dict[tuple, int] = {}
    per_doc: list[set[int]] = [set() for _ in texts]
    pairs_p, pairs_s = [], []
    before = np.concatenate([[-1], tok[:-1]])
    before[before == 0] = -1  # a text begins, or no test word
    before_test = np.where(t.start == t.first, -1, t.words[np.maximum(t.start - 1, 0)])
    for k in range(len(r.lo)):
        own, pos = r.suffix[r.cut[k] : r.cut[k + 1]], sa[r.lo[k] : r.hi[k]]
        kind = items.setdefault(tuple(np.unique(t.item[own]).tolist()), len(items))
        for d in np.unique(np.searchsorted(first, pos, "right") - 1).tolist():
            per_doc[d].add(kind)
        p, s = begins(pos, own, before[pos], before_test[own])
        pairs_p.append(p)
        pairs_s.append(s)
    sets = list(items)
    for d, kinds in enumerate(per_doc):
        out[d][2].extend(sorted({name for i in {i for k in kinds for i in sets[k]} for name in t.ids[i]}))
    # Longest matches are followed to their end.
    pos, which = np.concatenate(pairs_p), np.concatenate(pairs_s)
    size, on = t.window[which].copy(), np.arange(len(which))
    padded = np.append(tok, 0)
    while len(on):
        on = on[(t.left[which[on]] > size[on])]
        on = on[padded[np.minimum(pos[on] + size[on], len(tok))] == t.words[t.start[which[on]] + size[on]]]
        size[on] += 1
    order = np.lexsort((which, pos))
    pos, which, size = pos[order], which[order], size[order]
    doc = np.searchsorted(first, pos, "right") - 1
    item_word, doc_word = t.start[which] - t.first[which], pos - first[doc]
    for d, w, i, j, n in zip(doc.tolist(), which.tolist(), item_word.tolist(), doc_word.tolist(), size.tolist(), strict=True):
        out[d][3].append({"item_id": t.ids[t.item[w]][0], "item_word": i, "doc_word": j, "n_words": n})
    return out


def test_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """The files of the test items' blocks, which tasks write and every executor fetches; their names."""
    spark = items.sparkSession
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    texts = store(rows.groupBy("t").agg(F.collect_set("i").alias("ids")), "test-items")
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = texts.select(F.pmod(F.xxhash64("t"), F.lit(n)).alias("block"), "ids", "t").repartition(n, "block").sortWithinPartitions("block", "t")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[str], bytes]] = []
        last = None

        def block() -> pa.RecordBatch:
            made = pickle.dumps(tuple(test_suffixes(held, window)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.large_binary()).cast(pa.binary())], names=["block"])

        for batch in batches:
            for b, ids, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last and held:
                    yield block()
                    held = []
                last = b
                held.append((ids, text.encode()))
        if held:
            yield block()

    files = store(dealt.mapInArrow(build, "block binary"), "test-blocks").inputFiles()  # a name per block
    for f in files:
        spark.sparkContext.addFile(f)
    return sorted(f.rsplit("/", 1)[-1] for f in files)


class Blocks:
    """The blocks in a task: read from the fetched files one after the other; a single one stays in memory."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.only: list[TestSuffixes] | None = None

    def __iter__(self) -> Iterator[TestSuffixes]:
        import pyarrow.parquet as pq

        if self.only is not None:
            yield from self.only
            return
        read, first = 0, None
        for name in self.names:
            for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(1):
                for made in batch.column(0):
                    one = TestSuffixes(*pickle.loads(made.as_py()))
                    first, read = one if read == 0 else None, read + 1
                    yield one
        if read <= 1:
            self.only = [] if first is None else [first]


def united(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shard_bytes: int = 16 << 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``keep`` columns of each document and one struct column ``found``
    (n_words, hits: runs of hit words, items: ids found, matches: longest
    matches and their places in words)."""
    name = fresh(keep, "found")
    names = test_blocks(items, item_id, item_text, window, block_bytes)

    def make():
        blocks = Blocks(names)

        def fn(texts: pa.Array) -> list:
            raw = as_bytes(texts)
            total: list[dict] | None = None
            for tests in blocks:
                rows = [{"n_words": n, "hits": h, "items": i, "matches": m} for n, h, i, m in scan(raw, tests)]
                if total is None:
                    total = rows
                    continue
                for old, new in zip(total, rows, strict=True):
                    if new["hits"]:
                        old["hits"] = united(old["hits"] + new["hits"])
                        old["items"] = sorted({*old["items"], *new["items"]})
                        old["matches"] += new["matches"]
            return [total if total is not None else [{"n_words": len(split_words(x)), "hits": [], "items": [], "matches": []} for x in raw]]

        return fn

    return map_texts(docs, keep, text_col, T.StructType([T.StructField(name, REPORT)]), make, shard_bytes)


def n_hit(found: str):
    return F.aggregate(F.col(found)["hits"], F.lit(0).cast("bigint"), lambda a, x: a + x[1] - x[0])


def is_contaminated(found: str):
    """At least one word in twenty lies in a test window."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(found)["n_words"])


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The report per document: counts, a digest of the items found, and the verdict."""
    found = report(docs, items, [id_col], **options)
    name = found.columns[-1]
    ids = F.array_sort(F.array_distinct(F.col(name)["items"]))
    return found.select(
        id_col,
        F.col(name)["n_words"].alias("n_words"),
        n_hit(name).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        is_contaminated(name).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(F.col(name)["matches"], lambda m: m["n_words"])), F.lit(0).cast("bigint")).alias("longest_match"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = report(docs, items, docs.columns, **options)
    name = found.columns[-1]
    return found.filter(~is_contaminated(name)).drop(name)
