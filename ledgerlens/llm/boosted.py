"""A quality classifier: histogram gradient-boosted trees over document statistics.

1. Statistics of a text (lengths, shares of symbols, capitals and digits, repetition, line
   endings, entropy) are computed where the text is read; nothing else about a document
   is an input of its score.
2. About ``sample`` labelled rows (all, where there are fewer) are drawn by the hash of
   their id. Only their statistics reach the driver: a bounded matrix, cut into ``bins``
   quantile bins per statistic. Trees are grown level by level from histograms of gradients
   and curvatures of the logistic loss.
3. All trees are flattened into arrays (statistic, threshold and value by node; the children of
   node i are 2i + 1 and 2i + 2) and broadcast. Tasks score a batch by stepping through all
   trees at once, one level at a time.

Rows that the caller holds out never reach step 2. Null texts are empty texts; these have
statistics of zero and are scored by the model as any other. Rows without a label, and
labels but 0 and 1, are not learnt from. Of rows that share an id one is learnt from; of
contradicting labels each counts. Without labels of both kinds every score is the
share of label 1 among the rows learnt from (0.5 without any). Repeated rows get the same score, an
empty table an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, fresh, map_texts
from ledgerlens.llm.quality import BLANK, INNER, LETTER, SYMBOLS, UPPER, repeated_words, without

ENDS = b".!?:;"
STATISTICS = (
    "log_words", "log_chars", "word_length", "longest_word", "symbols", "capitals", "digits", "letters", "wide",
    "ends", "exclamations", "commas", "words_a_line", "dup_lines", "open_lines", "repeats", "variety", "top_word", "entropy",
)


def statistics(text: bytes) -> tuple[float, ...]:
    """The ``STATISTICS`` of a text; shares are of words, of letters or of lines."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    lines = [s for x in text.split(b"\n") if (s := x.strip(BLANK))]
    n, chars = len(words), without(text, BLANK + INNER)
    letters = len(text) - without(text, LETTER)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    shares = shares[shares > 0]
    return (
        float(np.log1p(n)),
        float(np.log1p(chars)),
        chars / n,
        float(np.log1p(max(map(len, kinds)))),
        (len(text) - without(text, SYMBOLS)) / n,
        (len(text) - without(text, UPPER)) / max(letters, 1),
        (len(text) - without(text, b"0123456789")) / max(chars, 1),
        letters / max(chars, 1),
        (len(text) - chars - (len(text) - without(text, BLANK))) / len(text),
        (len(text) - without(text, ENDS)) / n,
        text.count(b"!") / n,
        text.count(b",") / n,
        n / len(lines),
        (len(lines) - len(set(lines))) / len(lines),
        sum(x[-1] not in ENDS for x in lines) / len(lines),
        repeated_words(ids, len(kinds)) / n,
        len(kinds) / n,
        int(np.bincount(ids).max()) / n,
        float(-(shares * np.log2(shares)).sum()),
    )


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in as_bytes(texts)], np.float64).reshape(-1, len(STATISTICS))


# --- trees --------------------------------------------------------------------


class Trees(NamedTuple):
    """Complete trees one after the other; a node that does not split sends all rows left."""

    base: float
    depth: int
    feature: np.ndarray  # by inner node
    threshold: np.ndarray  # greater goes right
    value: np.ndarray  # by leaf


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per column the upper edges of its bins but the last."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]


def grow(x: np.ndarray, y: np.ndarray, *, rounds: int, depth: int, bins: int, rate: float, ridge: float, least: float) -> Trees:
    """Boosted trees for the chance that ``y`` is 1. A split needs ``least`` curvature on both sides."""
    nodes, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0, 1):
        return Trees(20 * float(np.sign(share - 0.5)), 0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    edges = quantile_edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: at or under edge b
    n_features = x.shape[1]
    column = np.arange(n_features) * bins
    base = np.log(share / (1 - share))
    score = np.full(len(y), base)
    feature, threshold, value = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        f, t, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (n_features * bins) + column + binned).ravel()
            size = n * n_features * bins
            g = np.bincount(cell, np.repeat(slope, n_features), size).reshape(n, n_features, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(curve, n_features), size).reshape(n, n_features, bins).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(n, -1).argmax(1)
            split = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            for i in np.flatnonzero(split):
                f[first + i] = best[i] // bins
                t[first + i] = edges[best[i] // bins][best[i] % bins]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        leaf = at - nodes
        v = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + ridge)
        score += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(float(base), depth, np.concatenate(feature), np.concatenate(threshold), np.concatenate(value))


def traverse(trees: Trees, x: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each row, through all trees at once."""
    if not trees.depth or not len(x):
        return np.full(len(x), 1 / (1 + np.exp(-trees.base)))
    nodes = 2**trees.depth - 1
    n_trees = len(trees.feature) // nodes
    tree, row = np.arange(n_trees) * nodes, np.arange(len(x))[:, None]
    at = np.zeros((len(x), n_trees), np.int64)
    for _ in range(trees.depth):
        node = tree + at
        at = 2 * at + 1 + (x[row, trees.feature[node]] > trees.threshold[node])
    total = trees.value[np.arange(n_trees) * (nodes + 1) + at - nodes].sum(1)
    return 1 / (1 + np.exp(-(trees.base + total)))


# --- the operator -------------------------------------------------------------


def fold(id_col: Column, folds: int = 3) -> Column:
    """A row's fold, from the CRC-32 of its id as text (a null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def drawn(labels: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of the rows (id, label), all where there are fewer: those of the least hashes of ids."""
    n = labels.count()
    if n <= sample:
        return labels
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    return labels.filter(share < sample / n)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 20_000,
    rounds: int = 150,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.1,
    ridge: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Trees learnt from the labelled rows of ``labels`` (ids, labels) whose texts are in ``docs``."""
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), label.alias("label")).filter("id is not null and label in (0, 1)").distinct()
    rows = drawn(known, sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")).join(F.broadcast(rows), "id")  # about ``sample`` rows
    stats = T.StructType([T.StructField("stats", T.ArrayType(T.DoubleType()))])
    made = map_texts(texts, ["id", "label"], "body", stats, lambda: lambda a: [pa.array(list(matrix(a)), pa.list_(pa.float64()))], 1 << 20)
    found = made.groupBy("id", "label").agg(F.min("stats").alias("stats")).orderBy("id", "label").collect()
    x = np.array([r.stats for r in found]).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r.label for r in found], float), rounds=rounds, depth=depth, bins=bins, rate=rate, ridge=ridge, least=least)


def scored(docs: DataFrame, trees: Trees, keep: list[str], *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``keep`` columns and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(trees))

    def make():
        own = Trees(*shared.value)
        return lambda texts: [pa.array(traverse(own, matrix(texts)))]

    return map_texts(docs, keep, text_col, T.StructType([T.StructField(fresh(keep, out_col), T.DoubleType())]), make, 2 << 20)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", holding_out: int | None = 1, **options) -> DataFrame:
    """Every document's id, ``held_out`` (its id is in fold ``holding_out`` of three: not learnt from) and ``score``."""
    out = F.lit(False) if holding_out is None else fold(F.col(f"`{id_col}`")) == holding_out
    trees = fit(docs, labels.filter(~out), id_col=id_col, text_col=text_col, **options)
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias(fresh([id_col], "body")))
    found = scored(src, trees, [id_col], text_col=src.columns[1])
    return found.select(id_col, out.alias("held_out"), found.columns[-1])
