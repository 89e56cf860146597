"""Token counts by section against a walk through the library's own tokens."""

from __future__ import annotations

import numpy as np
import public_tokenizers as P
import pytest
from helpers import awkward, documents

from ledgerlens.llm import tokencount as t

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.read_ranks(RANKS), special_tokens={})


def plain(encoding, text, rule):
    raw = (text or "").encode()
    owner = [None] * len(raw)
    for name, a, b in t.lines(raw):
        owner[a:b] = [name] * (b - a)
    owner = [x or "outside" for x in owner]
    got, at = {}, 0
    for token in encoding.encode_ordinary(text or ""):
        n = len(encoding.decode_single_token_bytes(token))
        own = owner[at : at + n]
        if rule == "first":
            got[own[0]] = got.get(own[0], 0) + 1
        elif rule == "split":
            for x in own:
                got[x] = got.get(x, 0) + 1 / n
        else:
            most = max(dict.fromkeys(own), key=own.count)
            got[most] = got.get(most, 0) + 1
        at += n
    return got


TEXTS = ["Title here\nBody of the text\n\n\nwith gaps", "only a heading", "\nbody first", "a  \n  b", "é\nü日本", "x \n \n y\n"]


@pytest.mark.parametrize("rule", t.RULES)
def test_equals_a_walk_through_the_tokens(spark, encoding, rule):
    texts = TEXTS + awkward(["some", "words", "of text"])
    rows = t.section_tokens(documents(spark, texts), RANKS, P.PATTERN, ["doc_id"], rule=rule).collect()
    for i, text in enumerate(texts):
        got = {r.section: r.n_tokens for r in rows if r.doc_id == i}
        want = plain(encoding, text, rule)
        assert {k: v for k, v in got.items() if abs(v) > 1e-9} == pytest.approx(want), text
        assert sum(got.values()) == pytest.approx(len(encoding.encode_ordinary(text or "")))


def test_crossing_tokens_by_each_rule():
    ends, sections = np.array([3, 9, 10]), [("a", 0, 4), ("b", 4, 8), ("c", 8, 10)]
    got = {rule: t.attribute(ends, sections, 10, rule) for rule in t.RULES}
    assert got["first"] == {"a": (2.0, 1), "b": (0.0, 0), "c": (1.0, 0)}
    assert got["majority"] == {"a": (1.0, 0), "b": (1.0, 1), "c": (1.0, 0)}
    assert {k: round(v, 6) for k, (v, _) in got["split"].items()} == {"a": 1.166667, "b": 0.666667, "c": 1.166667}


def test_other_sections_and_rules(spark):
    docs = documents(spark, ["abc"]).withColumnRenamed("lang", "section_")
    rows = t.section_tokens(docs, RANKS, P.PATTERN, ["doc_id"], sections=lambda raw: [("all", 0, len(raw))]).collect()
    assert [(r.section, r.n_tokens) for r in rows] == [("all", 1.0)]
    with pytest.raises(ValueError, match="rule"):
        t.section_tokens(docs, RANKS, P.PATTERN, ["doc_id"], rule="none")
    assert t.section_tokens(docs.limit(0), RANKS, P.PATTERN, ["doc_id"]).count() == 0


def test_names_that_clash_stay(spark):
    docs = documents(spark, ["one two"]).selectExpr("doc_id", "text", "'mine' as section", "7 as n_tokens")
    row = t.section_tokens(docs, RANKS, P.PATTERN, ["doc_id", "section", "n_tokens"]).collect()[0]
    assert (row["section"], row["n_tokens"]) == ("mine", 7) and {"_section", "_n_tokens", "n_crossing"} <= set(row.asDict())
