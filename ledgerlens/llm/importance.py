"""Importance resampling towards a target distribution of hashed n-grams.

Texts become counts of ``buckets`` hashed features: all runs of 1 to ``longest``
words, joined by one space. A bucket's *gain* compares its share of the target
texts with its share of the corpus, a document's *weight* is the floored mean
gain of its features, and its *score* adds Gumbel noise drawn from its id alone, so
that the highest scores are a sample without replacement, the same in every run.

Features are found by batch concatenation: the texts of a batch are joined with
separator sentinels, one pass of a regular expression finds all words and sentinels
of the batch, ``searchsorted`` over the places of the sentinels tells each word's
document, and runs that reach into the next document are masked before they are counted. The CRC-32 of
a run comes from those of its words (a checksum can be moved past the bytes that
follow by four table lookups), so no run is built as a string.

Every step covers the whole corpus: bucket counts are summed by Spark, the gains
(one number per bucket) are broadcast, and ranks come from a range sort with one
running offset per partition, so no task holds more than its range.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and
empty texts have no features and weight 0. A null id draws its noise as the empty
string. Ties of score go to the smaller id; repeated rows rank one after the other.
An empty table gives an empty result; an empty target counts 0 of every bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, chunks, map_texts, store

SENTINEL, SPACE = b"\0", zlib.crc32(b" ")
#: A word, or the sentinel.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
POLYNOMIAL = 0xEDB88320  # of CRC-32
BATCH = 1 << 20  # bytes of text that are joined
HELD = 200_000  # words whose checksums a task remembers


# --- checksums of runs --------------------------------------------------------


def byte_table() -> np.ndarray:
    """CRC-32 of one byte at a time."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


class Mover:
    """Moves checksums past ``n`` further bytes: crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""

    def __init__(self) -> None:
        self.table = byte_table()
        self.by_length: dict[int, np.ndarray] = {}
        self.stacked = np.zeros((0, 4, 256), np.uint32)

    def _past(self, n: int) -> np.ndarray:
        """What each byte of a checksum becomes (4 x 256), by squaring."""
        if n not in self.by_length:
            if n == 0:
                made = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
            elif n == 1:
                one = self._past(0)
                made = self.table[one & np.uint32(255)] ^ (one >> np.uint32(8))
            else:
                half = self._past(n // 2)
                made = self._apply(half[None], np.zeros(half.size, np.int64), half.ravel()).reshape(4, 256)
                if n % 2:
                    made = self.table[made & np.uint32(255)] ^ (made >> np.uint32(8))
            self.by_length[n] = made
        return self.by_length[n]

    @staticmethod
    def _apply(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = tables[which, 0, crc & np.uint32(255)]
        for k in range(1, 4):
            out ^= tables[which, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(n, return_inverse=True)
        if not len(kinds):
            return crc
        return self._apply(np.stack([self._past(int(k)) for k in kinds]), which, crc)


class Checksums(dict):
    """word -> its number, under which stand crc(word), crc(" " + word) and its length in bytes."""

    def __init__(self) -> None:
        super().__init__()
        self.alone, self.spaced, self.size = np.zeros(HELD, np.uint32), np.zeros(HELD, np.uint32), np.zeros(HELD, np.int64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.size):
            self.alone, self.spaced, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.alone, self.spaced, self.size))
        self.alone[i], self.spaced[i], self.size[i] = zlib.crc32(word), zlib.crc32(word, SPACE), len(word)
        self[word] = i
        return i


class Features:
    """Buckets of all runs of words in a batch of texts."""

    def __init__(self, longest: int, buckets: int) -> None:
        self.longest, self.buckets = longest, buckets
        self.move, self.known = Mover(), Checksums()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text; and per length of run, the bucket and the text of every run."""
        if len(self.known) > HELD:
            self.known = Checksums()
        known = self.known
        mark = known[SENTINEL]  # stands in no text any more, so it ends a text wherever it is found
        line = SENTINEL.join([*(x.replace(SENTINEL, b" ") for x in texts), b""]).lower()
        found = WORD.findall(line)
        word = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        ends = np.flatnonzero(word == mark)
        word = np.delete(word, ends)
        ends -= np.arange(len(ends))  # words up to the end of each text
        owner = np.searchsorted(ends, np.arange(len(word)), "right")
        runs, crc, size, spaced = [], known.alone[word], known.size[word], known.spaced[word]
        for n in range(1, self.longest + 1):
            if n > 1:
                crc = self.move(crc[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
            inside = owner[: len(crc)] == owner[n - 1 : n - 1 + len(crc)]
            runs.append(((crc[inside] % np.uint32(self.buckets)).astype(np.int64), owner[: len(crc)][inside]))
        return np.diff(ends, prepend=0), runs


# --- the operator -------------------------------------------------------------


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sends a row per bucket it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for b in chunks(batches, 0, BATCH):
            for bucket, _ in features(as_bytes(b.column(0)))[1]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> DataFrame:
    """(bucket, gain) of the buckets that the corpus has: how much likelier the target is to have them."""
    sums = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of_corpus")).crossJoin(
        F.broadcast(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of_target")))  # one row each
    )
    both = corpus.join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")  # a row per bucket at most
    t, s = F.coalesce("t", F.lit(0)).cast("double"), F.col("n").cast("double")
    all_t, all_s = F.col("of_target").cast("double"), F.col("of_corpus").cast("double")
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(scale * F.ln(ratio)).cast("bigint").alias("gain"))


def noise(id_col: Column, seed: int, scale: int = 1000) -> Column:
    """Gumbel noise, floored, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-scale * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, its place in ``order`` (1, 2, ...), and ``n_rows``, over the whole table.

    Rows are dealt by range and numbered within their partition; a row per partition gives what stands before it.
    """
    dealt = store(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offset = parts.select(
        "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), F.sum("c").over(Window.partitionBy()).alias("n_rows")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(offset), "part").withColumn("rank", (F.col("offset") + F.col("place")).cast("bigint")).drop("part", "place", "offset")


def weighted(docs: DataFrame, table: dict[int, int], keep: list[str], text_col: str, longest: int, buckets: int) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_features`` and ``weight`` of every document."""
    gain = np.zeros(buckets, np.int64)
    gain[list(table)] = list(table.values())
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def make() -> Callable[[pa.Array], list]:
        features, gain = Features(longest, buckets), shared.value

        def fn(texts: pa.Array) -> list:
            words, runs = features(as_bytes(texts))
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for bucket, owner in runs:
                n += np.bincount(owner, minlength=len(texts))
                upto = np.concatenate([[0], np.cumsum(gain[bucket])])
                total += np.diff(upto[np.searchsorted(owner, np.arange(len(texts) + 1))])
            return [pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

        return fn

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return map_texts(docs, keep, text_col, T.StructType(fields), make, BATCH)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """Every document's id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if it was not drawn).

    Of the documents with ``least_words`` words, ``percent`` per cent (rounded down) with the highest scores are drawn.
    """
    corpus = store(bucket_counts(docs, text_col, longest, buckets), "bucket-counts")
    wanted = bucket_counts(target, text_col, longest, buckets)
    table = {r.bucket: r.gain for r in gains(corpus, wanted, buckets).collect()}  # ``buckets`` rows at most
    rows = weighted(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")), table, ["id"], "body", longest, buckets)
    scored = store(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.asc("weight")]
    places = ranked(scored.filter(able), order)
    drawn = F.col("rank") <= F.floor(percent * F.col("n_rows") / 100)
    drawn_rows = places.withColumn("rank", F.when(drawn, F.col("rank"))).drop("n_rows")
    out = drawn_rows.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns. Rows that share an id with a drawn one, and text features with it, go with it."""
    found = resampled(docs, target, id_col=id_col, text_col=text_col, **options)
    ids = found.filter("rank is not null").select(F.col(id_col).alias("drawn_id")).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(ids["drawn_id"]), "left_semi")
