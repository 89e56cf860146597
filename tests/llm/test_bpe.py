"""Encoding against the tokenizer's own library; decoding as an exact round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from helpers import awkward, by_id, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import bpe

PATH = P.path("byte_bpe_50k.json")
PIECES = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "\xa0", "\u3000", "a", "xyz", "é", "日本", "1", "٣", "23", "!", "...", "<|endoftext|>", "<|endo", "🙂", "don't", "'D", "\x85", "\x1c", "\u0301"]


TOK, LIBRARY = bpe.read_tokenizer(PATH), Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@pytest.fixture(scope="module")
def tok():
    return TOK


class Local:
    """An encoder over a lexicon of ``words``: token ids of all texts, and how many each has."""

    def __init__(self, tok, words):
        first = np.array(tok["first"], np.int32)
        lex = bpe.compile_lexicon(sorted(words)) | bpe.pair_tables(tok["merges"]) | {"first": first}
        ids, at = bpe.ragged([bpe.merge_word(w, tok["first"], tok["merges"]) for w in sorted(words)])
        self.run = bpe.Encoder(lex | {"ids": ids.astype(np.int64), "ids_at": at}, tok["added"])

    def __call__(self, data, ends):
        made = self.run(data, ends)
        return bpe.gather(made.ids, made.at, made.which)[0], made.lengths()


@pytest.mark.parametrize("words", [[], [b" the", b"a", b"xyz", b"'t", b"!", b"...", b" a", b"don"]])
def test_ids_equal_the_library(library, tok, words):
    rnd = random.Random(len(words))
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(2000)] + ["", None, "a" * 5000, " " * 50, "<|endoftext|>" * 3]
    ids, n = Local(tok, words)(*bpe.flat(pa.array(texts, pa.string())))
    ends = np.cumsum(n)
    for x, a, b in zip(texts, (ends - n).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == library.encode(x or "", add_special_tokens=False).ids, x


ENCODER = Local(TOK, [b" a", b"0"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    ids, _ = ENCODER(*bpe.flat(pa.array([text], pa.string())))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_numbers_its_words():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", "é".encode()})
    lex = bpe.compile_lexicon(words)
    data, at = bpe.ragged([np.frombuffer(w, np.uint8) for w in words + [b"to", b"tapsy", b"x", b""]])
    got = bpe.walk(lex, data.astype(np.uint8), at[:-1], at[1:])
    assert got.tolist() == [*range(len(words)), -1, -1, -1, -1]
    # States: the dead one and 9 kinds of right language (of a word's start and of the rests of tap, top, stop, é).
    rests = {frozenset(w[k:] for w in words if w[:k] == p) for w in words for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(lex["accepts"]) == 1 + len(rests)


def test_long_words_merge_like_short_ones(tok, library):
    word = "".join(random.Random(1).choice("thequickbrown") for _ in range(20_000))
    assert bpe.merge_word(word.encode(), tok["first"], tok["merges"]) == library.encode(word).ids


def test_words_merged_together_equal_words_merged_alone(tok):
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"thequickbr own,.aaa\xc3\xa9") for _ in range(rnd.randint(1, 45))) for _ in range(3000)] + [b"a" * k for k in range(1, 200)] + ["日本語の長い文字列です".encode() * k for k in (1, 2, 3, 5)]
    body, at = bpe.ragged([np.frombuffer(w, np.uint8) for w in words])
    ids, begin = bpe.Merger(np.array(tok["first"], np.int32), bpe.pair_tables(tok["merges"]))(body, at)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [bpe.merge_word(w, tok["first"], tok["merges"]) for w in words]


def test_a_file_without_merges():
    merger = bpe.Merger(np.arange(256, dtype=np.int32), bpe.pair_tables({}))
    ids, begin = merger(np.frombuffer(b"abc", np.uint8), np.array([0, 1, 3]))
    assert ids.tolist() == [97, 98, 99] and begin.tolist() == [0, 1, 3]


def test_counts_of_words(spark, tok):
    texts = ["a b a", None, "", "a <|endoftext|> b" * 3, "x" * 40]
    got = {bytes(r.word): r.n for r in bpe.word_counts(documents(spark, texts), "text", tok["added"], 32, held=2).collect()}
    assert got == {b"a": 2, b" b": 2, b" a": 1, b" ": 3, b" ba": 2}


def test_frequent_words(spark):
    rows = [(b"w%d" % i, 1 + i // 3) for i in range(60)]
    counted = spark.createDataFrame(rows, "word binary, n bigint")
    got = bpe.frequent_words(counted, 10)
    assert 0 < len(got) <= 10 and set(got) <= {w for w, n in rows if n >= 15}
    assert bpe.frequent_words(counted, 1000) == sorted(w for w, _ in rows)
    assert bpe.frequent_words(counted.limit(0), 5) == []
    # A step of more words than there is room for gives some of them.
    flat = spark.range(5000).selectExpr("cast(cast(id as string) as binary) as word", "7L as n")
    assert 300 < len(bpe.frequent_words(flat, 500)) <= 500


def test_operator_and_digests(spark, library):
    texts = awkward(["some", "words", "don't"]) + ["<|endoftext|>x", "🙂 é"]
    docs = documents(spark, texts).withColumnRenamed("lang", "ids")
    got = by_id(bpe.round_trip(docs, PATH, lexicon_size=5))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
        )
    coded = bpe.encode(docs, PATH)
    assert coded.columns == [*docs.columns, "_ids"]
    back = bpe.decode(coded, PATH, ids_col="_ids")
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library_on_a_whole_table(spark, library):
    import __spark_entry__ as contract

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = by_id(contract.queries()["op10_bpe"](spark, "/root/testdata/sf0.01"))
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got[d.doc_id])[1:] == want
