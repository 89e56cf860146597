"""Quality by weak supervision.

Rules look at the counts of a text and vote good, bad or abstain. Votes are
grouped into patterns (at most 3 ** number of rules, counted over all
documents by Spark), expectation-maximisation over the pattern counts
estimates how often each rule is right of each kind of text and how common these are, and the
posterior probability of a text's pattern decides. No rule decides alone,
but for the base checks of the caller, which this module only reports.

Words are ``[^\\x20\\x09-\\x0D]+``. Null or empty texts have no words; every rule
abstains on them but the one on length. An empty table gives an empty result.
Repeated rows get the same result.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, fresh, map_texts, store

BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
INNER = bytes(range(0x80, 0xC0))  # bytes that begin no character
UPPER = bytes(range(0x41, 0x5B))
LETTER = UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
WINDOW = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_distinct"]


def without(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside ``WINDOW``-word windows that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    if kinds < 1 << 20:
        key = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    word = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        word[k : k + n] |= twice
    return int(word.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of a text."""
    words = text.split()
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    chars = without(text, BLANK + INNER)
    return (
        len(words),
        chars,
        len(text) - without(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(kinds)),
        len(lines),
        len(text) - without(text, LETTER),
        len(text) - without(text, UPPER),
        len(kinds),
    )


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def make():
        def fn(texts: pa.Array) -> list:
            rows = np.array([counts(x) for x in as_bytes(texts)], np.int64).reshape(-1, len(COUNTS))
            return [pa.array(c) for c in rows.T.copy()]

        return fn

    return map_texts(docs, keep, text_col, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]), make)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    words, lines = F.col("n_words"), F.col("n_lines")

    def ratio(name: str, of: Column, good_upto: float, bad_from: float) -> Column:
        share = F.col(name) / F.nullif(of, F.lit(0))
        return F.when(of <= 0, 0).when(share >= bad_from, -1).when(share <= good_upto, 1).otherwise(0)

    length = F.col("word_chars") / F.nullif(words, F.lit(0))
    return {
        "length": F.when(words < 5, -1).when(words >= 60, 1).otherwise(0),
        "word_length": F.when(words <= 0, 0).when((length < 2.5) | (length > 14), -1).when((length >= 3) & (length <= 11), 1).otherwise(0),
        "symbols": ratio("n_symbols", words, 0.02, 0.2),
        "dup_lines": ratio("n_dup_lines", lines, 0.1, 0.5),
        "repeats": ratio("n_repeat_words", words, 0.1, 0.4),
        "letters": F.when(words <= 0, 0).when(F.col("n_letters") < 0.6 * F.col("word_chars"), -1).when(F.col("n_letters") >= 0.85 * F.col("word_chars"), 1).otherwise(0),
        "upper": ratio("n_upper", F.col("n_letters"), 0.15, 0.4),
        "variety": F.when(words < 20, 0).when(F.col("n_distinct") < 0.1 * F.least(words, F.lit(200)), -1).otherwise(0),
    }


#: Where estimation starts: how often a rule says bad of good texts (and of texts that are bad in
#: another way), and of the texts that are bad in the way this rule looks for.
START_GOOD, START_BAD = 0.02, 0.9


def estimate(
    patterns: np.ndarray,
    n: np.ndarray,
    *,
    steps: int = 3000,
    pseudo: float = 10.0,
    prior: float = 0.85,
    most: float = 0.02,
    own: float = 0.5,
) -> dict[str, Any]:
    """Expectation-maximisation over vote patterns (rows of 1, 0, -1) met ``n`` times.

    A text is good, or bad in one of as many ways as there are rules; each kind
    of text has its own rate of every rule's saying bad where it votes. An abstention says nothing, but that
    the rule did not catch the kind of text that it looks for.

    The starting rates and shares stand before the data as ``pseudo`` votes for each kind and
    rule, however large the corpus is. Votes alone cannot tell a kind of bad text that one rule alone catches
    from good texts that this rule is wrong about, so two bounds keep the kinds apart: a
    rule is wrong about ``most`` of the good texts at the utmost, and says bad of ``own`` of its own kind at least.

    Returns the share of each kind (good first), the rates (kind, rule), and each pattern's posterior of being good.
    """
    n_rules = patterns.shape[1]
    rule = np.arange(n_rules)
    bad = (patterns == -1).astype(float)
    fine = np.tile((patterns == 1).astype(float)[:, None, :], (1, n_rules + 1, 1))  # pattern, kind, rule
    fine[:, rule + 1, rule] = 1 - bad
    start = np.full((n_rules + 1, n_rules), START_GOOD)
    start[rule + 1, rule] = START_BAD
    first = np.array([prior, *[(1 - prior) / n_rules] * n_rules])
    rates, share, post = start, first, np.tile(first, (len(n), 1))
    for _ in range(steps):
        log = np.log(share) + bad @ np.log(rates).T + np.einsum("pkr,kr->pk", fine, np.log(1 - rates))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        w = post * n[:, None]
        said, not_said = w.T @ bad, np.einsum("pk,pkr->kr", w, fine)
        rates = (said + pseudo * start) / (said + not_said + pseudo)
        rates[0] = np.minimum(rates[0], most)
        rates[rule + 1, rule] = np.maximum(rates[rule + 1, rule], own)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        before, share = share, (w.sum(0) + pseudo * first) / (n.sum() + pseudo)
        if np.abs(before - share).max() < 1e-7:
            break
    return {"share": share, "rates": rates, "posterior": post[:, 0]}


def judged(docs: DataFrame, keep: list[str], *, text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``keep`` columns, the counts, ``p_good`` (6 places) and ``good`` (p_good at or over the threshold).

    A ``keep`` column that is called like one of these stays; the new one gets underscores before its name.
    ``options``: of ``estimate``.
    """
    names = {c: fresh(keep, c) for c in (*COUNTS, "p_good", "good")}
    own = {c: f"k{i}" for i, c in enumerate(keep)}
    src = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    votes = rules()
    counted = store(text_counts(src, list(own.values())), "quality-counts")
    place = sum(((v + 1) * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    coded = counted.withColumn("pattern", place)
    met = coded.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    code = np.array([r.pattern for r in met], np.int64)
    n = np.array([r.n for r in met], float)
    rows = np.stack([code // 3**i % 3 - 1 for i in range(len(votes))], 1) if len(met) else np.zeros((0, len(votes)))
    post = estimate(rows, n, **options)["posterior"]
    table = docs.sparkSession.createDataFrame(
        [(int(c), round(float(p), 6)) for c, p in zip(code, post, strict=True)], "pattern int, p_good double"
    )
    out = coded.join(F.broadcast(table), "pattern")  # at most 3 ** len(votes) rows
    found = out.withColumn("good", F.col("p_good") >= threshold)
    return found.select(*[F.col(k).alias(c) for c, k in own.items()], *[F.col(c).alias(name) for c, name in names.items()])


def base_failed() -> Column:
    """Too short, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
