"""Token counts by section, from one encoding of the whole text.

A text is encoded once, as a whole; every token covers a span of its bytes,
and spans are joined to the sections' spans by interval. A token that lies
across a section boundary is given out by an explicit rule:

* ``first``: to the section that holds its first byte;
* ``majority``: to the section that holds most of its bytes (the earlier of equals);
* ``split``: to each section in proportion to the bytes it holds.

Bytes of no section (such as the line break between two) belong to
``outside``. The counts of a text's sections always add up to its tokens.

Sections come from a function of the text (default: ``lines``, the first line as
``heading``, the other lines as ``body``). Null or empty texts have no tokens:
one row, ``outside``, of 0. Repeated rows get the same result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, fresh, map_texts

OUTSIDE = "outside"
RULES = ("first", "majority", "split")


def lines(text: bytes) -> list[tuple[str, int, int]]:
    """(section, start, end) in bytes: the first line is the heading, the others are the body."""
    end = text.find(b"\n")
    if end < 0:
        return [("heading", 0, len(text))]
    return [("heading", 0, end), ("body", end + 1, len(text))]


def attribute(ends: np.ndarray, sections: list[tuple[str, int, int]], size: int, rule: str) -> dict[str, tuple[float, int]]:
    """Of each section name: its tokens and how many of them lie across a boundary.

    ``ends``: where each token ends, in bytes; tokens follow one another. ``sections`` may
    leave gaps but not overlap.
    """
    names, cuts = [], []
    at = 0
    for name, a, b in sorted(sections, key=lambda s: s[1]):
        if a > at:
            names.append(OUTSIDE)
            cuts.append(a)
        if b > a:
            names.append(name)
            cuts.append(b)
        at = max(at, b)
    if at < size or not names:
        names.append(OUTSIDE)
        cuts.append(size)
    edge = np.array(cuts, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(edge, starts, "right")
    last = np.searchsorted(edge, ends, "left")
    n = np.bincount(first, minlength=len(names)).astype(float)
    crossing = np.zeros(len(names), np.int64)
    for t in np.flatnonzero(last > first).tolist():
        low = np.concatenate([[starts[t]], edge[first[t] : last[t]]])
        high = np.append(edge[first[t] : last[t]], ends[t])
        share = (high - low) / (ends[t] - starts[t])
        if rule == "split":
            n[first[t]] -= 1
            n[first[t] : last[t] + 1] += share
            crossing[first[t] : last[t] + 1] += 1
            continue
        owner = first[t] if rule == "first" else first[t] + int(np.argmax(share))
        n[first[t]] -= 1
        n[owner] += 1
        crossing[owner] += 1
    out: dict[str, tuple[float, int]] = {}
    for name, x, c in zip(names, n.tolist(), crossing.tolist(), strict=True):
        have = out.get(name, (0.0, 0))
        out[name] = (have[0] + x, have[1] + c)
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


SECTION = T.StructType([T.StructField("section", T.StringType()), T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType())])


def section_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    keep: list[str],
    *,
    text_col: str = "text",
    sections: Callable[[bytes], list[tuple[str, int, int]]] = lines,
    rule: str = "first",
) -> DataFrame:
    """``keep`` columns and a row per section of each text: section, n_tokens, n_crossing.

    A ``keep`` column that is called like one of these stays; the new one gets underscores before its name.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))  # the vocabulary file bounds it
    name = fresh([*keep, *SECTION.names], "sections")

    def make():
        import tiktoken

        ranks, pat = shared.value
        enc = tiktoken.Encoding("ranks", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        width[list(ranks.values())] = [len(x) for x in ranks]

        def fn(texts: pa.Array) -> list:
            out = []
            for raw in as_bytes(texts):
                ids = np.array(enc.encode_ordinary(raw.decode()), np.int64)
                got = attribute(np.cumsum(width[ids]), sections(raw), len(raw), rule) if raw else {OUTSIDE: (0.0, 0)}
                out.append([{"section": s, "n_tokens": n, "n_crossing": c} for s, (n, c) in got.items()])
            return [out]

        return fn

    made = map_texts(docs, keep, text_col, T.StructType([T.StructField(name, T.ArrayType(SECTION))]), make, 4 << 20)
    return made.select(*[F.col(f"`{c}`") for c in keep], F.inline(name).alias(*[fresh(keep, c) for c in SECTION.names]))
