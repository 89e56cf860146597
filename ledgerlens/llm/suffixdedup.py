"""Exact substring deduplication: bytes covered by a ``length``-byte string that
also starts anywhere else in the corpus are removed.

Suffixes are sorted by external induction (``induced``), shard by shard; two
equal strings must meet in one shard, so windows (strings of ``length`` bytes)
are dealt by content:

1. Each window has the least hash of the ``gram``-byte strings in it. A run of
   windows with the same least hash is a *piece*; equal windows have equal
   hashes, so they lie in pieces of the same key. This takes two passes of
   whole-array operations over a text and no shuffle of text.
2. Keys with one piece (and the least gram once in it) hold no repeat. Pieces
   that are equal as a whole, such as those of exact copies, are one class:
   classes of two or more are repeats throughout, and only one text of a class is
   looked at further. What is left are pieces of equal key and different texts.
3. These are cut out of their documents and dealt by key. Stretches of windows
   that no other piece of the key can share, or that others share as a whole, are
   settled there (``narrowed``); the rest is sorted in shards of
   ``shard_bytes``: suffix arrays with common prefixes. A window whose
   common prefix with a neighbour reaches ``length`` is a repeat.

A key with more than ``hot_pieces`` different texts (a passage that a good part
of all documents share, each going on in its own way) goes to no single task: its
stretches are dealt by their shared bytes and counted with partial aggregation like whole
pieces in step 2 (``spread``), and what is left is cut down to single windows, each a class by
itself. So is at once a key with more than that, or of more than ``hot_bytes``, if one of its pieces has the
least gram twice: such pieces (periodic stretches: rulers, padding) go on for up to a
slice, the others for less than two windows. Of the windows that such a piece has
twice one goes on; their places are known to be repeated. The tasks that sort get
``TASK_BYTES`` of pieces each, however large the corpus is.

Hashes only deal windows out and tell equal pieces of equal keys (128 bits
in all). Texts are UTF-8 bytes; null is empty. Matches never cross documents.
Rows are told apart by id and text, repeated rows are repeats of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.llm.common import as_bytes, discard, fresh, map_texts, store
from ledgerlens.llm.induced import Scratch, sort_suffixes

LENGTH, GRAM = 400, 64
STRETCH = 42
SLICE = 1 << 18  # window starts that are hashed at a time
ROWS, ROW_BYTES = 1 << 14, 4 << 20  # rows, and bytes of pieces, that are put out at a time
ODD = 0x9E3779B97F4A7C15
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000  # of pieces that one task sorts, shard by shard; and tasks that they are dealt to


# --- windows and pieces -------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, modulo 2 ** 64, for i < n."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (ODD, pow(ODD, -1, 1 << 64)))


class Grams:
    """Hashes of all ``gram``-byte strings of a byte array."""

    def __init__(self, gram: int) -> None:
        self.gram, self.up, self.down = gram, *powers(1)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[self.gram :] - total[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours, from running extremes of blocks of that width."""
    n = len(a) - width + 1
    pick = np.minimum if least else np.maximum
    padded = np.full(-(-len(a) // width) * width, np.iinfo(a.dtype).max if least else 0, a.dtype)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, ends: np.ndarray, grams: Grams, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, first window, windows, place of its least gram or -1 if that is in it twice) of all pieces of the texts
    that end at ``ends``."""
    width = length - grams.gram + 1
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        upto = min(at + SLICE, len(data) - length + 1)
        h = grams(data[at : upto + length - 1])
        key = sliding(h, width, True)
        start = np.arange(at, upto)
        good = start + length <= ends[np.searchsorted(ends, start, "right")]
        text = np.searchsorted(ends, start, "right")
        cut = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])])
        first = np.flatnonzero(cut)
        n = np.diff(np.append(first, upto - at))
        keep = good[first]
        first, n = first[keep], n[keep]
        # Places of least grams: where a gram is as great as the greatest of the least hashes around it.
        shown = np.where(good, key, np.uint64(0))
        around = sliding(np.concatenate([np.zeros(width - 1, np.uint64), shown, np.zeros(width - 1, np.uint64)]), width, False)
        place = np.flatnonzero(h == around)
        low, high = np.searchsorted(place, first), np.searchsorted(place, first + n + width - 1)
        gram_at, on, k = np.full(len(first), -2), np.arange(len(first)), 0
        while len(on):
            on = on[(low[on] + k < high[on]) & (gram_at[on] != -1)]
            here = place[low[on] + k]
            hit = h[here] == key[first[on]]
            gram_at[on[hit]] = np.where(gram_at[on[hit]] == -2, here[hit] + at, -1)
            k += 1
        yield key[first], first + at, n, gram_at


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


PIECE = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("piece", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("gram_at", T.LongType()),
    ]
)


def document_pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, row, key, piece, start, n, gram_at) of all pieces of ``docs`` (id, row, text)."""

    def make():
        grams = Grams(gram)

        def fn(texts: pa.Array) -> list:
            data, ends = flat(as_bytes(texts))
            raw = memoryview(data)
            starts = np.concatenate([[0], ends])
            got = list(pieces(data, ends, grams, length))
            key, first, n, gram_at = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, k) for i, k in enumerate((np.uint64, *[np.int64] * 3)))
            digest = np.fromiter(
                (xxhash.xxh3_64_intdigest(raw[a : a + m + length - 1]) for a, m in zip(first.tolist(), n.tolist(), strict=True)), np.uint64, len(n)
            )
            owner = np.searchsorted(ends, first, "right")
            offsets = np.searchsorted(owner, np.arange(len(ends) + 1))
            gram_at = np.where(gram_at < 0, -1, gram_at - starts[owner])
            rows = pa.StructArray.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(first - starts[owner]), pa.array(n), pa.array(gram_at)], PIECE.names
            )
            return [pa.ListArray.from_arrays(offsets.astype(np.int32), rows)]

        return fn

    made = map_texts(docs, ["id", "row"], "text", T.StructType([T.StructField("pieces", T.ArrayType(PIECE))]), make, 1 << 19)
    return made.select("id", "row", F.inline("pieces"))


# --- shards -------------------------------------------------------------------


def repeated_windows(texts: list[bytes], length: int, scratch: Scratch) -> list[np.ndarray]:
    """Of each text, the starts of the ``length``-byte strings that also start elsewhere in these texts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    line = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    t = scratch.array(len(line) + 1, np.uint16)
    t[:-1] = line
    t[:-1] += 2
    ends = np.cumsum(size + 1)
    t[ends - 1] = 1  # after each text; strings that reach it are no windows
    t[-1] = 0
    order, shared = sort_suffixes(t, length, scratch)
    same = np.flatnonzero(np.asarray(shared) >= length)
    starts = np.unique(np.concatenate([order[same], order[same - 1]]))
    owner = np.searchsorted(ends, starts, "right")
    begin = ends[owner] - 1 - size[owner] if len(starts) else starts
    good = starts + length <= begin + size[owner] if len(starts) else np.zeros(0, bool)
    owner, at = owner[good], (starts - begin)[good]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [at[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of neighbouring starts."""
    if not len(starts):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(starts) != 1) + 1, [len(starts)]])
    return [(int(starts[a]), int(b - a)) for a, b in zip(cut, cut[1:], strict=False)]


def stretches(start: int, gram_at: int, text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """The windows of a piece by stretches of the place of its least gram: (number of the stretch, first window, windows,
    bytes that all windows of a whole stretch share, bytes of these windows).

    Where the least gram is in each piece of a key once, equal windows have it at the same place, so they lie in
    stretches of equal number that share the same bytes.
    """
    a = gram_at - start
    first, last = a - (len(text) - length), a  # places of the gram in its windows
    for low in range(first - first % STRETCH, last + 1, STRETCH):
        high = min(low + STRETCH - 1, length - gram)
        x, y = max(low, first), min(high, last)
        yield low, start + a - y, y - x + 1, text[a - low : a + length - high], text[a - y : a - x + length]


def narrowed(group: list[tuple], length: int, gram: int) -> tuple[list[tuple], list[tuple]]:
    """What of one key's pieces (many, id, row, start, gram_at, bytes) is still to be sorted, in the same form
    without ``gram_at``, and what is known to be repeated: (id, row, start, n).

    A stretch whose shared bytes no other piece has holds no repeat; stretches that are equal as a whole are repeats.
    """
    if len(group) < 2 or any(g[4] < 0 for g in group):
        return [(*g[:4], g[5]) for g in group], []
    meet: dict[tuple[int, bytes], dict[tuple[int, int, bytes], list[tuple]]] = {}
    for g in group:
        _, _, _, start, gram_at, text = g
        for low, at, n, core, whole in stretches(start, gram_at, text, length, gram):
            meet.setdefault((low, core), {}).setdefault((gram_at - at, n, whole), []).append((g, at))
    sort, known = [], []
    for kinds in meet.values():
        alone = len(kinds) == 1
        for (_, n, whole), members in kinds.items():
            several = len(members) > 1 or members[0][0][0]
            if several:
                known += [(g[1], g[2], at, n) for g, at in members if not g[0]]
            if not alone:
                g, at = members[0]
                sort.append((several, g[1], g[2], at, whole))
    return sort, known


def spread(hot: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``narrowed`` for keys with many pieces, as aggregations: no task gets a key.

    ``hot``: the pieces (key, many, id, row, start, gram_at, bytes). They are dealt by (key, stretch, hash of the
    shared bytes) and equal stretches are counted, map-side first. Gives what is known to be repeated (id, row,
    start, n), and what is left as single windows (key, window, many, id, row, start).
    """
    ids = [hot.schema[c] for c in ("id", "row")]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("key", "kind")), T.StructField("many", T.BooleanType()), *ids, *(T.StructField(c, T.LongType()) for c in ("piece", "start", "n"))])
    arrow = to_arrow_schema(schema)

    def told(*parts: object) -> int:
        h = xxhash.xxh3_64()
        for x in parts:
            h.update(x if isinstance(x, bytes) else int(x).to_bytes(8, "little", signed=True))
        return int.from_bytes(h.digest(), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, many, i, row, start, gram_at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low, at, n, core, whole in stretches(start, gram_at, text, length, gram):
                    out.append((told(key, low, core), told(gram_at - at, n, whole), many, i, row, start, at, n))
            yield _rows(out, arrow)

    src = hot.select("key", "many", "id", "row", "start", "gram_at", "bytes")
    found = store(src.mapInArrow(run, schema), "hot-stretches")
    one = F.min(F.struct("id", "row", "piece", "start", "n"))
    kinds = store(found.groupBy("key", "kind").agg((F.max("many") | (F.count("*") > 1)).alias("several"), one.alias("one")), "hot-kinds")
    known = found.filter("not many").join(kinds.filter("several").select("key", "kind"), ["key", "kind"]).select("id", "row", "start", "n")
    shared = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key")
    left = kinds.join(shared, "key").select("key", "several", "one.*")
    lists = left.groupBy("id", "row", "piece").agg(F.collect_list(F.struct("key", "several", "start", "n")).alias("want"))  # a few per piece
    lists = lists.select(F.col("id").alias("of_id"), F.col("row").alias("of_row"), "piece", "want")
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")) & (F.col("start") == F.col("piece"))
    texts = src.join(lists, same).select("id", "row", "start", "bytes", "want")
    single = T.StructType([*(T.StructField(c, T.LongType()) for c in ("key", "window")), T.StructField("many", T.BooleanType()), *ids, T.StructField("start", T.LongType())])
    single_arrow = to_arrow_schema(single)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row, start, text, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = memoryview(text)
                for w in want:
                    for at in range(w["start"], w["start"] + w["n"]):
                        h = int.from_bytes(xxhash.xxh3_64_digest(raw[at - start : at - start + length]), "big", signed=True)
                        out.append((w["key"], h, w["several"], i, row, at))
                if len(out) >= ROWS:
                    yield _rows(out, single_arrow)
                    out = []
            yield _rows(out, single_arrow)

    return known, texts.mapInArrow(windows, single)


def few_rows(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, ``n`` at a time: what is made of their texts is in memory for these only."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def sorted_shards(cut: DataFrame, id_type: T.DataType, length: int, gram: int, shard_bytes: int, memory: int, tasks: int) -> DataFrame:
    """(id, row, start, n): repeated runs of windows of the pieces (key, many, id, row, start, gram_at, bytes), in ``tasks`` tasks."""
    dealt = cut.select("key", "many", "id", "row", "start", "gram_at", "bytes").repartition(tasks, "key").sortWithinPartitions("key")
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("row", "start", "n"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = Scratch(memory)
        held: list[tuple] = []  # of the shard
        group: list[tuple] = []  # of the last key
        size, key = 0, None

        def sort() -> pa.RecordBatch:
            out = []
            for (many, i, row, start, _), found in zip(held, repeated_windows([r[-1] for r in held], length, scratch), strict=True):
                if not many:  # a class of several is known to be repeated throughout
                    out += [(i, row, start + a, n) for a, n in runs(found)]
            return _rows(out, arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key and group:
                    left, known = narrowed(group, length, gram)
                    if known:
                        yield _rows(known, arrow)
                    held += left
                    size += sum(len(r[-1]) for r in left)
                    group = []
                    if size >= shard_bytes:
                        yield sort()
                        held, size = [], 0
                key = row[0]
                group.append(row[1:])
        left, known = narrowed(group, length, gram)
        held += left
        yield _rows(known, arrow)
        if held:
            yield sort()

    return dealt.mapInArrow(run, schema)


CUT = T.StructType([*(T.StructField(c, T.LongType()) for c in ("start", "gram_at", "window", "n")), T.StructField("bytes", T.BinaryType())])


def hot_windows(raw: memoryview, start: int, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of a piece: its different windows (first start, hash, whether it is in the piece twice), and the runs of those that are."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + length]) for s in range(start, start + n)), np.uint64, n).view(np.int64)
    kinds, at, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    twice = times > 1
    return start + at, kinds, twice, runs(start + np.flatnonzero(twice[which]))


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(id, row, key, many, start, gram_at, window, n, bytes) of the wanted pieces (id, row, key, start, n, gram_at, many, periodic):
    their bytes, or for those of large periodic keys a row per different window with its hash (``many``: known to be repeated, here or
    elsewhere) and a row per run of ``n`` windows that the piece itself repeats."""
    lists = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("key", "start", "n", "gram_at", "many", "periodic")).alias("pieces"))
    joined = docs.join(lists, docs["id"].eqNullSafe(lists["id"]) & (docs["row"] == lists["row"])).select(docs["id"], docs["row"], "pieces", "text")
    # Repeated rows are one text: a piece is cut out once.
    out = T.StructType([joined.schema["id"], T.StructField("row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("many", T.BooleanType()), *CUT.fields])
    arrow = to_arrow_schema(out)

    def found(i, row: int, want: list[dict], raw: memoryview) -> Iterator[tuple]:
        for p in want:
            a, n, key, many = p["start"], p["n"], p["key"], p["many"]
            if not p["periodic"]:
                yield i, row, key, many, a, p["gram_at"], None, None, bytes(raw[a : a + n + length - 1])
                continue
            starts, kinds, twice, again = hot_windows(raw, a, n, length)
            for at in range(0, len(starts), ROWS):
                part = slice(at, at + ROWS)
                for s, h, t in zip(starts[part].tolist(), kinds[part].tolist(), twice[part].tolist(), strict=True):
                    yield i, row, key, many or t, s, None, h, None, None
            if not many:  # a class of several is known to be repeated throughout
                for s, m in again:
                    yield i, row, key, many, s, None, None, m, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        for batch in few_rows(batches):
            for i, row, want, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in found(i, row, want, memoryview((text or "").encode())):
                    rows.append(r)
                    size += len(r[-1] or b"")
                    if len(rows) >= ROWS or size >= ROW_BYTES:
                        yield _rows(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield _rows(rows, arrow)

    return joined.mapInArrow(run, out)


# --- the operator -------------------------------------------------------------


def repeated_runs(docs: DataFrame, *, length: int, gram: int, shard_bytes: int, hot_pieces: int, hot_bytes: int, memory: int) -> DataFrame:
    """(id, row, start, n): runs of repeated windows of ``docs`` (id, row, text); runs may touch."""
    found = store(document_pieces(docs, length, gram), "pieces")
    # Repeated rows come as equal pieces of one (id, row): counted each, looked at once.
    keys = found.groupBy("key").agg(F.count("*").alias("all"), F.min("piece").alias("least"), F.max("piece").alias("most"), F.min("gram_at").alias("gram_at"))
    keys = keys.filter((F.col("all") > 1) | (F.col("gram_at") < 0)).select("key", (F.col("least") == F.col("most")).alias("alike"), "all")
    open_ = store(found.join(keys, "key"), "open-pieces")
    discard(found)
    same = open_.filter("alike and all > 1").select("id", "row", "start", "n")
    mixed = open_.filter("not alike or all = 1")
    classes = store(
        mixed.groupBy("key", "piece").agg(F.count("*").alias("members"), F.min(F.struct("id", "row", "start", "n", "gram_at")).alias("one")),
        "piece-classes",
    )
    many = classes.filter("members > 1").select("key", "piece")
    copies = mixed.join(many, ["key", "piece"]).select("id", "row", "start", "n")
    size = F.sum(F.col("one.n") + length - 1)
    wide = classes.groupBy("key").agg(F.count("*").alias("kinds"), size.alias("size"), F.min("one.gram_at").alias("gram_at"))
    hot, twice = F.col("kinds") > hot_pieces, F.col("gram_at") < 0
    wide = store(wide.select("key", "size", (hot & ~twice).alias("hot"), (twice & (hot | (F.col("size") > hot_bytes))).alias("periodic")), "wide-keys")
    large = wide.filter("hot or periodic").select("key", "hot", "periodic")
    wanted = classes.join(large, "key", "left").select(
        "key", "one.id", "one.row", "one.start", "one.n", "one.gram_at", (F.col("members") > 1).alias("many"), F.coalesce("periodic", F.lit(False)).alias("periodic")
    )
    cut = store(cut_out(docs, wanted, length), "cut-pieces")
    texts = cut.filter("bytes is not null")
    total = wide.filter("not hot and not periodic").agg(F.sum("size")).first()[0] or 0
    tasks = min(MOST_TASKS, 1 + total // TASK_BYTES)
    few = texts.join(large.filter("hot").select("key"), "key", "left_anti")
    sorted_ = sorted_shards(few, docs.schema["id"].dataType, length, gram, shard_bytes, memory, tasks)
    out = same.unionByName(copies).unionByName(sorted_)
    windows = cut.filter("window is not null").select("key", "window", "many", "id", "row", "start")
    if large.filter("hot").limit(1).count():
        known, more = spread(store(texts.join(large.filter("hot").select("key"), "key"), "hot-pieces"), length, gram)
        out, windows = out.unionByName(known), windows.unionByName(more)
    windows = store(windows, "windows")
    counted = store(windows.groupBy("key", "window").agg(F.count("*").alias("c"), F.max("many").alias("any")).filter("c > 1 or any").select("key", "window"), "window-counts")
    # Joins of written tables are split where a window is in many documents.
    single = windows.filter("not many").join(counted, ["key", "window"]).select("id", "row", "start", F.lit(1).cast("bigint").alias("n"))
    periodic = cut.filter("n is not null").select("id", "row", "start", "n")
    return out.unionByName(single).unionByName(periodic)


def kept_pieces(size: int, found: list[dict], length: int) -> tuple[list[tuple[int, int]], int, int]:
    """Spans kept, bytes removed, and maximal removed spans, of a text of ``size`` bytes."""
    kept, removed, spans, at = [], 0, 0, 0
    for a, n in sorted((r["start"], r["n"]) for r in found):
        b = min(size, a + n - 1 + length)
        if a > at or not spans:
            spans += 1
            if a > at:
                kept.append((at, a))
            at = a
        if b > at:
            removed += b - at
            at = b
    if at < size:
        kept.append((at, size))
    return kept, removed, spans


def _with_runs(docs: DataFrame, keep: list[str], id_col: str, text_col: str, options: dict) -> tuple[DataFrame, str]:
    row = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = repeated_runs(src, **options).distinct()
    i, r, c = (fresh(docs.columns, x) for x in ("run_id", "run_row", "runs"))
    lists = found.groupBy(F.col("id").alias(i), F.col("row").alias(r)).agg(F.collect_list(F.struct("start", "n")).alias(c))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (row == F.col(r))
    return docs.select(*[F.col(f"`{x}`") for x in keep]).join(lists, same, "left").drop(i, r), c


DEFAULTS = {"length": LENGTH, "gram": GRAM, "shard_bytes": 1 << 20, "hot_pieces": 1_000, "hot_bytes": 4 << 20, "memory": 128 << 20}


def substring_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and the digest of the bytes kept."""
    options = DEFAULTS | options
    length = options["length"]
    rows, c = _with_runs(docs, [id_col, text_col], id_col, text_col, options)
    fields = [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    src = rows.select(id_col, F.col(text_col).cast("string"), c)
    schema = T.StructType([src.schema[0], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out = []
            for raw, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, removed, spans = kept_pieces(len(raw), found or [], length)
                digest = hashlib.sha256()
                view = memoryview(raw)
                for a, b in kept:
                    digest.update(view[a:b])
                out.append((len(raw), removed, spans, digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(cols, list(arrow)[1:], strict=True))], schema=arrow)

    return src.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All documents and columns, the text without repeated bytes (what is left of a cut character becomes U+FFFD)."""
    options = DEFAULTS | options
    length = options["length"]
    rows, c = _with_runs(docs, docs.columns, id_col, text_col, options)

    @F.pandas_udf(T.StringType())
    def kept(texts, found):
        def one(text, runs_):
            if text is None or runs_ is None:
                return text
            raw = text.encode()
            return b"".join(raw[a:b] for a, b in kept_pieces(len(raw), list(runs_), length)[0]).decode("utf-8", "replace")

        return texts.combine(found, one)

    return rows.withColumn(text_col, kept(F.col(f"`{text_col}`").cast("string"), c)).drop(c)
