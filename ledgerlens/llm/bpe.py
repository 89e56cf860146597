"""Byte-pair encoding and decoding with a minimal acyclic transducer.

1. One job counts the pre-tokens ("words") of all texts; the most frequent ones,
   up to ``lexicon_size``, are the lexicon (it decides speed only, never ids).
2. The driver compiles them into a minimal acyclic automaton whose edges carry
   outputs: equal suffixes share states, and the outputs on a word's path add
   up to its number, under which its token ids are listed. The tables go to the
   shared folder once; executors fetch the file and memory-map it.
3. Tasks cut texts into pre-tokens and walk the automaton for all different words of
   a batch at once. Those it does not accept are merged exactly, pair by pair,
   round by round and all together.
4. Decoding maps ids back to bytes.

The tokenizer is a byte-level BPE file (vocabulary, merges, added tokens); its
path is a parameter. Added tokens in a text become their own ids, as the
file's own library does. Null or empty texts have no tokens. Nothing is
shuffled but word counts.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import chunks, fresh, map_texts, shared_folder, store

OTHER, LETTER, NUMBER, SPACE = range(4)
#: What follows an apostrophe in a contraction.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Code points of white space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


# --- the tokenizer file -------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: itself where
    printable, else the next one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 0x100
    for b in range(256):
        out[chr(b if b in own else extra)] = b
        extra += b not in own
    return out


def read_tokenizer(path: str) -> dict[str, Any]:
    """Plain values of a byte-level BPE file: token bytes by id, merges as (left, right) -> (rank, id), added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
    token_bytes = [b""] * size
    for word, i in vocab.items():
        token_bytes[i] = bytes(letters[c] for c in word)
    added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    for content, i in added.items():
        token_bytes[i] = content
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    first = [0] * 256
    for letter, b in letters.items():
        first[b] = vocab[letter]
    return {"bytes": token_bytes, "merges": merges, "first": first, "added": added}


def merge_word(word: bytes, first: list[int], merges: dict) -> list[int]:
    """Token ids of one pre-token: the lowest-ranked adjacent pair is merged until none is left."""
    ids = [first[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = merges[a, b][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if m := merges.get((ids[i], ids[k])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
            heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
    return [x for x in ids if x >= 0]


LONGEST = 64  # bytes of words that are merged together
WIDTHS = (0, 4, 8, 12, 18, 32, LONGEST)
NO_PAIR = (1 << 20) - 1  # an id that no token has
NO_RANK = np.iinfo(np.int32).max


def pair_tables(merges: dict) -> dict[str, np.ndarray]:
    """The merges as sorted pair keys with their ranks, and the token that each rank makes."""
    key = np.array([a << 20 | b for a, b in merges], np.int64)
    rank, made = (np.array([m[i] for m in merges.values()], np.int64) for i in (0, 1))
    order, token = np.argsort(key), np.zeros(int(rank.max(initial=-1)) + 1, np.int32)
    token[rank] = made
    return {"pair": key[order], "pair_rank": rank[order].astype(np.int32), "pair_token": token}


class Merger:
    """Merges many different words together.

    Words of like length are rows of a matrix. In each round every row merges the leftmost of its lowest-ranked pairs, so
    all rows that go on lose one column; pairs beside the merge get their ranks by binary search in the sorted pair keys.
    """

    def __init__(self, first: np.ndarray, tables: dict[str, np.ndarray]) -> None:
        self.first, self.pair, self.rank, self.token = first, tables["pair"], tables["pair_rank"], tables["pair_token"]
        self._merges: dict | None = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair):
            return np.full(left.shape, NO_RANK, np.int32)
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NO_RANK)

    def together(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` (a row per word, filled up with NO_PAIR) merged, and how many are left of each row."""
        out, left = ids.copy(), np.zeros(len(ids), np.int64)
        row = np.arange(len(ids))
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            lowest = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), NO_RANK)
            done = lowest == NO_RANK
            out[row[done], : ids.shape[1]] = ids[done]
            left[row[done]] = (ids[done] != NO_PAIR).sum(1)
            on = ~done
            row, ids, rank, best, lowest = row[on], ids[on], rank[on], best[on, None], lowest[on]
            if not len(row):
                break
            np.put_along_axis(ids, best, self.token[lowest][:, None], 1)
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > best), 1)
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= best), 1)
            at, k = best[:, 0], np.arange(len(row))
            for shift in (1, 0):  # the pair that ends in the new token, and the one that begins with it
                some = np.flatnonzero((at >= shift) & (at - shift < rank.shape[1]))
                a = at[some] - shift
                rank[k[some], a] = self.ranks(ids[some, a], ids[some, a + 1])
        return out, left

    def __call__(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words that lie one after the other in ``body``, cut at ``at``, and where each word's begin."""
        size = np.diff(at)
        n, parts = np.zeros(len(size), np.int64), []
        for low, high in zip(WIDTHS, WIDTHS[1:], strict=False):
            which = np.flatnonzero((size > low) & (size <= high))
            if len(which):
                column = np.arange(high)
                inside = column < size[which, None]
                place = np.where(inside, at[which, None] + column, 0)
                ids, n[which] = self.together(np.where(inside, self.first[body[place]], NO_PAIR).astype(np.int32))
                parts.append((which, ids))
        long = np.flatnonzero(size > LONGEST)
        lists = [merge_word(body[at[i] : at[i + 1]].tobytes(), self.first.tolist(), self.merges) for i in long.tolist()]
        n[long] = [len(x) for x in lists]
        begin = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(int(begin[-1]), np.int64)
        for which, ids in parts:
            column = np.arange(ids.shape[1])
            inside = column < n[which, None]
            out[(begin[which, None] + column)[inside]] = ids[inside]
        for i, x in zip(long.tolist(), lists, strict=True):
            out[begin[i] : begin[i + 1]] = x
        return out, begin

    @property
    def merges(self) -> dict:
        if self._merges is None:
            token = self.token[self.rank]
            self._merges = {(k >> 20, k & NO_PAIR): (r, t) for k, r, t in zip(self.pair.tolist(), self.rank.tolist(), token.tolist(), strict=True)}
        return self._merges


# --- pre-tokens ---------------------------------------------------------------


def class_table() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at ``at``."""
    lead = data[at]
    cp = lead.astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        where = np.flatnonzero((lead >= low) & (lead < high))
        if len(where):
            x = lead[where].astype(np.int32) & mask
            for k in range(1, more + 1):
                x = (x << 6) | (data[at[where] + k] & 0x3F)
            cp[where] = x
    return cp


def byte_kinds(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, bool]:
    """The class of the character that each byte belongs to, and whether there is white space of several bytes."""
    kind = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return kind, False
    found = classes[code_points(data, lead)]
    for k in range(4):
        on = lead if k < 2 else lead[data[lead] >= (0xE0, 0xF0)[k - 2]]
        kind[on + k] = found if k < 2 else found[data[lead] >= (0xE0, 0xF0)[k - 2]]
    return kind, bool((found == SPACE).any())


def pre_tokens(data: np.ndarray, ends: np.ndarray, classes: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each pre-token of the texts that end at ``ends`` in ``data``, and the id of those
    that are added tokens (else -1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw, spans = data.tobytes(), []
    for content, i in added.items():
        at = raw.find(content)
        while at >= 0:
            if np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + len(content) - 1, "right"):
                spans.append((at, at + len(content), i))
            at = raw.find(content, at + len(content))
    stops = np.unique(np.concatenate([[0], ends, [x for s in spans for x in s[:2]]]).astype(np.int64))
    kind, wide = byte_kinds(data, classes)
    stop = np.zeros(n + 1, bool)  # a text (or what is between added tokens) begins here
    stop[stops] = True
    stop[n] = True
    space, blank = kind == SPACE, data == 32
    if wide:  # what a character of several bytes stands for is at its first byte
        inner = (data & 0xC0) == 0x80
        first = np.flatnonzero(~inner)
        after = np.append(first[1:], n)  # where each character's next one begins
        solid = np.zeros(n, bool)  # before a character that is no white space
        solid[first] = ~stop[after] & ~space[np.minimum(after, n - 1)]
        before = np.concatenate([[0], first[:-1]])
        prev_space, prev_blank, prev_kind = np.zeros(n, bool), np.zeros(n, bool), kind.copy()
        prev_space[first[1:]], prev_blank[first[1:]], prev_kind[first[1:]] = space[before[1:]], blank[before[1:]], kind[before[1:]]
        start = np.where(space, ~prev_space | solid, np.where(prev_space, ~prev_blank, kind != prev_kind)) & ~inner
        start |= stop[:n]
    else:
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])  # begins white space, or another kind after no white space
        start[1:] &= ~(blank[:-1] & ~space[1:])  # a blank goes before what follows it
        start[:-1] |= space[:-1] & ~space[1:] & ~stop[1:-1]  # the last white space before something is by itself
        start |= stop[:n]
    # Contractions: an apostrophe that begins a pre-token takes the letters after it.
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):
        room = np.append(np.flatnonzero(stop), n)
        room = room[np.searchsorted(room, quote, "right")] - quote
        longer = np.append(data, [0, 0])
        for tail in CONTRACTIONS:
            is_it = (room > len(tail)) & np.logical_and.reduce([longer[np.minimum(quote + 1 + k, n + 1)] == c for k, c in enumerate(tail)])
            hit = quote[is_it]
            for k in range(len(tail)):
                start[hit + 1 + k] = False
            rest = hit + 1 + len(tail)
            start[rest[rest < n]] = True
    for a, b, _ in spans:
        start[a + 1 : b] = False
    begin = np.flatnonzero(start)
    number = np.full(len(begin), -1, np.int64)
    for a, _, i in spans:
        number[np.searchsorted(begin, a)] = i
    return begin, np.append(begin[1:], n), number


def words_of(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The pre-tokens, which tile ``data``, as one Arrow array over the same bytes."""
    offsets = np.append(begin, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


# --- the lexicon --------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str, added: dict[bytes, int], longest: int, held: int = 1 << 20) -> DataFrame:
    """(word, n) over all texts, for words of up to ``longest`` bytes."""
    src = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, parts, size = class_table(), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in chunks(batches, 0, 4 << 20):
            data, ends = flat(b.column(0))
            begin, end, number = pre_tokens(data, ends, classes, added)
            words, use = words_of(data, begin), (number < 0) & (end - begin <= longest)
            found = (words if use.all() else words.filter(pa.array(use))).value_counts()
            parts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            size += len(found)
            if size > held:
                parts = [summed()]
                size = len(parts[0])
                if size > held // 2:
                    yield from parts[0].combine_chunks().to_batches()
                    parts, size = [], 0
        if parts:
            yield from summed().combine_chunks().to_batches()

    return src.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, most: int) -> list[bytes]:
    """The most frequent words, ``most`` at the utmost, sorted: all words from some count on.

    That count is found from a histogram of counts (eight steps per doubling, so a few hundred rows),
    so the driver gets no more than the lexicon however many tasks there are. Of the step that goes over
    ``most``, as many words as there is room for are taken by their hash.
    """
    counted = store(counted, "word-counts")
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    found = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    use, total = F.lit(False), 0
    for r in sorted(found, key=lambda r: -r.step):
        if total + r.words > most:
            share = 0.9 * (most - total) / r.words  # in expectation; room for chance is left
            use = use | (step == r.step) & (F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40)))
            break
        use, total = step >= r.step, total + r.words
    return sorted(bytes(r.word) for r in counted.filter(use).select("word").collect())[:most]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text ends (null: empty)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, ends[1:] - ends[0]


def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of ``words`` (sorted, distinct, not empty).

    ``table[state, letter]`` holds the next state (high half; 0: none) and the
    edge's output (low half); a word's number is the sum of its outputs.
    """
    states: list[tuple[bool, tuple]] = []  # (accepts, edges) of each finished state
    known: dict[tuple[bool, tuple], int] = {}

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, {}]]  # the open states along the last word
    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1][1][last[i - 1]] = finish(path.pop())
        for b in word[same:]:
            path[-1][1][b] = None
            path.append([False, {}])
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1][last[i - 1]] = finish(path.pop())
    root = finish(path[0])
    letters = sorted({b for _, edges in states for b, _ in edges})
    letter = np.zeros(256, np.int64)
    letter[letters] = np.arange(1, len(letters) + 1)
    width = len(letters) + 1
    table = np.zeros((len(states) + 1) * width, np.int64)
    below = np.zeros(len(states), np.int64)  # words accepted from a state; children are finished before their parents
    for s, (accepts, edges) in enumerate(states):
        total = int(accepts)
        for b, child in edges:
            table[(s + 1) * width + letter[b]] = ((child + 1) << 32) | total
            total += int(below[child])
        below[s] = total
    return {
        "table": table,
        "letter": letter,
        "accepts": np.array([False, *(a for a, _ in states)]),
        "root": np.array([root + 1, width], np.int64),
    }


def walk(lex: dict[str, np.ndarray], data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of each word in the lexicon, or -1."""
    root, width = lex["root"].tolist()
    state = np.full(len(begin), root, np.int64)
    number = np.zeros(len(begin), np.int64)
    on, at = np.flatnonzero(begin < end), begin.copy()
    table, letter = lex["table"], lex["letter"]
    while len(on):
        edge = table[state[on] * width + letter[data[at[on]]]]
        step = edge >> 32
        state[on] = step
        number[on] += edge & 0xFFFFFFFF
        at[on] += 1
        on = on[(step > 0) & (at[on] < end[on])]
    return np.where(lex["accepts"][state] & (at == end), number, -1)


def ship(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """The arrays as one file that every executor fetches; its name."""
    head, body = {}, io.BytesIO()
    for k, a in arrays.items():
        body.write(b"\0" * (-body.tell() % 64))
        head[k] = (body.tell(), a.dtype.str, len(a))
        body.write(np.ascontiguousarray(a).tobytes())
    top = json.dumps(head).encode()
    blob = len(top).to_bytes(8, "little") + top
    blob += b"\0" * (-len(blob) % 64) + body.getvalue()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(blob), 1 << 22):
        out.write(bytearray(blob[at : at + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def mapped(name: str) -> dict[str, np.ndarray]:
    """The arrays of a shipped file, memory-mapped: workers on one machine share its pages."""
    whole = np.memmap(SparkFiles.get(name), np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    at = -(-(8 + n) // 64) * 64
    return {
        k: np.frombuffer(whole, np.dtype(kind), size, at + offset)
        for k, (offset, kind, size) in json.loads(whole[8 : 8 + n].tobytes()).items()
    }


def ragged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and the place where each begins (and the last ends)."""
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=at[1:])
    return np.concatenate([np.asarray(x) for x in parts]) if parts else np.zeros(0, np.int64), at


def build(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", lexicon_size: int = 65536, longest: int = 32) -> tuple[dict, str]:
    """The tokenizer's plain values and the name of the shipped lexicon of ``docs``."""
    tok = read_tokenizer(tokenizer_path)
    words = frequent_words(word_counts(docs, text_col, tok["added"], longest), lexicon_size)
    arrays = compile_lexicon(words) | pair_tables(tok["merges"]) | {"first": np.array(tok["first"], np.int32)}
    ids, at = Merger(arrays["first"], arrays)(*ragged([np.frombuffer(w, np.uint8) for w in words]))
    arrays |= {"ids": ids, "ids_at": at}
    body, where = ragged([np.frombuffer(x, np.uint8) for x in tok["bytes"]])
    text, places = ragged([np.frombuffer(b"%d," % i, np.uint8) for i in range(len(tok["bytes"]))])
    arrays |= {"token": body.astype(np.uint8), "token_at": where, "digit": text.astype(np.uint8), "digit_at": places}
    return tok, ship(docs.sparkSession, arrays)


# --- encoding and decoding ----------------------------------------------------


def gather(body: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ``which`` of a ragged table, joined, and each one's length."""
    n = at[which + 1] - at[which]
    shift = at[which] - (np.cumsum(n) - n)
    return body[np.arange(int(n.sum())) + np.repeat(shift, n)], n


class Encoded(NamedTuple):
    """A batch: its different pre-tokens' ids one after the other, and which of them every pre-token is."""

    ids: np.ndarray
    at: np.ndarray  # where each different pre-token's ids begin
    which: np.ndarray
    cut: np.ndarray  # where each text's pre-tokens begin

    def lengths(self) -> np.ndarray:
        """How many ids each text has."""
        total = np.concatenate([[0], np.cumsum(np.diff(self.at)[self.which])])
        return np.diff(total[self.cut])


class Encoder:
    """Encodes batches of texts in a task."""

    def __init__(self, lex: dict[str, np.ndarray], added: dict[bytes, int]) -> None:
        self.lex, self.added, self.classes = lex, added, class_table()
        self.merge = Merger(lex["first"], lex)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> Encoded:
        begin, _, _ = pre_tokens(data, ends, self.classes, self.added)
        if not len(begin):
            return Encoded(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64))
        coded = words_of(data, begin).dictionary_encode()
        kinds = coded.dictionary
        where = np.frombuffer(kinds.buffers()[1], np.int32)[: len(kinds) + 1].astype(np.int64)
        body = np.frombuffer(kinds.buffers()[2], np.uint8)
        word = walk(self.lex, body, where[:-1], where[1:])
        table, at = self.lex["ids"], self.lex["ids_at"]
        new = np.flatnonzero(word < 0)
        more, more_at = self.merge(*piece(body, where, new))
        word[new] = len(at) - 1 + np.arange(len(new))
        special = [(k, i) for content, i in self.added.items() if (k := kinds.index(pa.scalar(content, pa.binary())).as_py()) >= 0]
        if special:  # no pre-token but an added token itself spells one
            last = more_at[-1]
            more, more_at = np.append(more, [i for _, i in special]), np.append(more_at, last + 1 + np.arange(len(special)))
            word[[k for k, _ in special]] = len(at) - 1 + len(new) + np.arange(len(special))
        table, at = np.concatenate([table, more]), np.concatenate([at, more_at[1:] + at[-1]])
        ids, n = gather(table, at, word)
        cut = np.concatenate([[0], np.searchsorted(begin, ends, "left")])
        return Encoded(ids, np.concatenate([[0], np.cumsum(n)]), coded.indices.to_numpy(), cut)


def piece(body: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some words of a ragged table as one of their own."""
    found, n = gather(body, at, which)
    return found, np.concatenate([[0], np.cumsum(n)])


def _encoder(tok: dict, name: str, spark: SparkSession):
    shared = spark.sparkContext.broadcast(tok["added"])
    return lambda: Encoder(mapped(name), shared.value)


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, *, text_col: str = "text", **options) -> DataFrame:
    """``keep`` columns (all, unless given) and ``ids``, the token ids of the text."""
    keep = docs.columns if keep is None else keep
    encoder = _encoder(*build(docs, tokenizer_path, text_col=text_col, **options), docs.sparkSession)

    def make():
        run = encoder()

        def fn(texts: pa.Array) -> list:
            made = run(*flat(texts))
            ids, _ = gather(made.ids, made.at, made.which)
            return [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(made.lengths())]).astype(np.int32), pa.array(ids.astype(np.int32)))]

        return fn

    return map_texts(docs, keep, text_col, T.StructType([T.StructField(fresh(keep, "ids"), T.ArrayType(T.IntegerType()))]), make, 4 << 20)


def decode(df: DataFrame, tokenizer_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` and the texts of its ids (null ids: null; bytes that are no UTF-8 become U+FFFD)."""
    shared = df.sparkSession.sparkContext.broadcast(ragged([np.frombuffer(x, np.uint8) for x in read_tokenizer(tokenizer_path)["bytes"]]))

    @F.pandas_udf(T.StringType())
    def texts(col):
        body, at = shared.value
        return col.map(lambda x: None if x is None else gather(body, at, np.asarray(x, np.int64))[0].astype(np.uint8).tobytes().decode("utf-8", "replace"))

    return df.withColumn(fresh(df.columns, out_col), texts(ids_col))


def round_trip(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: tokens, the digest of its ids (decimal, comma-joined), and the digest of what they decode to."""
    encoder = _encoder(*build(docs, tokenizer_path, text_col=text_col, **options), docs.sparkSession)

    def make():
        run = encoder()
        lex = run.lex

        def digests(body: np.ndarray, at: np.ndarray, made: Encoded, tail: int) -> list[str]:
            """Of each text, the digest of what ``body`` has for its ids, but for the last ``tail`` bytes."""
            found, n = gather(body, at, made.ids)
            by_word = np.concatenate([[0], np.cumsum(n)])[made.at]
            words = pa.Array.from_buffers(pa.large_binary(), len(by_word) - 1, [None, pa.py_buffer(by_word), pa.py_buffer(found)])
            line = words.take(pa.array(made.which))
            upto = np.frombuffer(line.buffers()[1], np.int64)[made.cut].tolist() if len(line) else [0] * len(made.cut)
            raw = memoryview(line.buffers()[2]) if len(line) else memoryview(b"")
            return [hashlib.sha256(raw[a : max(a, b - tail)]).hexdigest() for a, b in zip(upto, upto[1:], strict=False)]

        def fn(texts: pa.Array) -> list:
            made = run(*flat(texts))
            return [
                pa.array(made.lengths()),
                digests(lex["digit"], lex["digit_at"], made, 1),
                digests(lex["token"], lex["token_at"], made, 0),
            ]

        return fn

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, [id_col], text_col, T.StructType(fields), make, 4 << 20)
