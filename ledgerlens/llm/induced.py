"""Suffix sorting by recursive induction, with common-prefix values carried along, for strings larger than memory.

``sort_suffixes`` sorts all suffixes of a number string and gives the length of
the common prefix of each with its predecessor, up to a cap. The suffixes that
are local minima (LMS) are sorted first, by recursion on the string of their
names; all others are induced from them.

Induction works off priority queues, one per first letter, in letter order. Their entries are tuples of a
suffix and its common prefix with the entry before it, in two arrays: a queue is a
stretch of them that is filled in order and read in order. A queue is extracted in batches of
at most ``BATCH`` tuples; a batch pushes the suffixes one letter longer onto their queues. The
common prefix of two suffixes pushed one after the other onto a
queue is one more than the least value between those that pushed them, which
a table of range minima over the batch answers, and a number per queue from batch to batch.

All arrays as long as the string or as its names (text, types, order, common prefixes, LMS suffixes,
names, digits) come from ``Scratch``: in memory up to a limit, beyond that in files on the task's own disk
that are unlinked at once, so nothing is left behind, and they are gone through in stretches of ``BATCH``. In
memory are then a few batches and the numbers per letter. Common prefixes over a
queue's two halves are compared directly, a few times per letter.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Letters up to which names are used as they are; more are written as two digits.
ALPHABET = 4096
#: Strings of names up to this length are sorted by doubling, which ends the recursion.
SMALL = 1 << 16
#: Tuples that are extracted, and elements of a long array that are looked at, together.
BATCH = 1 << 16


class Scratch:
    """Arrays in memory, or in unlinked files if they are larger than ``limit`` bytes."""

    def __init__(self, limit: int = 256 << 20) -> None:
        self.limit = limit

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.limit:
            return np.zeros(n, kind)
        with tempfile.TemporaryFile() as f:
            return np.memmap(f, kind, "w+", shape=(n,))

    def places(self, n: int) -> np.ndarray:
        """An array of ``n`` places in a string."""
        return self.array(n, np.int32 if n < 1 << 31 else np.int64)


def stretches(n: int, backwards: bool = False) -> Iterator[tuple[int, int]]:
    """[0, n) in parts of ``BATCH``."""
    begins = range(0, n, BATCH)
    for a in reversed(begins) if backwards else begins:
        yield a, min(n, a + BATCH)


def common_prefix(t: np.ndarray, i: np.ndarray, j: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Letters that the suffixes i and j share (the first ``start`` are known to be), up to ``cap``.

    The last letter of ``t`` is met once only, so a comparison ends before the string does.
    """
    out = np.minimum(start, cap).astype(np.int64)
    on = np.flatnonzero(out < cap)
    while len(on):
        at = out[on]
        on = on[t[i[on] + at] == t[j[on] + at]]
        out[on] += 1
        on = on[out[on] < cap]
    return out


class RangeMinima:
    """Least value between any two places of a short array."""

    def __init__(self, a: np.ndarray) -> None:
        self.rows = [a]
        width = 1
        while 2 * width <= len(a):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of [low, high], both included, low <= high."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level):
            w = level == k
            row = self.rows[k]
            out[w] = np.minimum(row[low[w]], row[high[w] - (1 << int(k)) + 1])
        return out


class Queues:
    """The queues of one direction: suffixes pushed by extracted batches.

    ``step`` +1 fills queues from their left end (suffixes larger than their
    successor, letters ascending), -1 from their right end (smaller ones, descending).
    ``lcp`` holds, for each pushed suffix, its common prefix with the one pushed before it onto its queue.
    """

    def __init__(self, t, small, wanted: bool, sa, lcp, edge, letters: int, step: int, cap: int) -> None:
        self.t, self.small, self.wanted, self.sa, self.lcp = t, small, wanted, sa, lcp
        self.next, self.step, self.cap = edge.copy(), step, cap
        self.since = np.zeros(letters, np.int32)  # least common prefix since a letter's queue was last pushed onto

    def new_letter(self) -> None:
        self.since[:] = 0  # what was pushed under another letter shares nothing after its first

    def extract(self, batch: np.ndarray, shared: np.ndarray | None) -> None:
        """Push the predecessors of a batch; ``shared``: common prefix of each with the one extracted before it."""
        before = batch - 1
        at = np.flatnonzero((self.small[before] == self.wanted) & (before >= 0))
        if len(at):
            before = before[at]
            to = self.t[before]
            order = np.argsort(to, kind="stable")
            to, at, before = to[order], at[order], before[order]
            first = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1])
            size = np.diff(first, append=len(to))
            letter = to[first]
            place = np.repeat(self.next[letter] - self.step * first, size) + self.step * np.arange(len(to))
            self.sa[place] = before
            self.next[letter] += self.step * size
        if shared is None or not len(batch):
            return
        low = np.minimum.accumulate(shared)
        if not len(at):
            np.minimum(self.since, low[-1], out=self.since)
            return
        got = self._between(shared, at, first, size)
        got[first] = np.minimum(self.since[letter], low[at[first]])
        self.lcp[place] = np.minimum(got + 1, self.cap)
        np.minimum(self.since, low[-1], out=self.since)
        high = np.minimum.accumulate(shared[::-1])[::-1]
        last = at[first + size - 1] + 1
        self.since[letter] = np.where(last < len(shared), high[np.minimum(last, len(shared) - 1)], self.cap)

    @staticmethod
    def _between(shared: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each pushed suffix, the least of ``shared`` since the one pushed before it onto its queue
        (at the ``first`` of each queue: nothing useful)."""
        after = np.empty(len(at), np.int64)
        after[0] = 0
        after[1:] = at[:-1] + 1
        after[first] = at[first]
        if int((at - after).sum()) > 24 * len(at):  # many letters: stretches overlap many times over
            return RangeMinima(shared).least(after, at).astype(np.int64)
        ends = np.empty(2 * len(at), np.int64)
        ends[::2], ends[1::2] = after, at + 1
        return np.minimum.reduceat(np.append(shared, 0), ends)[::2].astype(np.int64)


def induce(t, small, lms, lms_shared, starts, larger, letters: int, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, from the LMS suffixes in order (of their first letters, at least), and
    their common prefixes if those of the LMS suffixes are given.

    ``starts``: where each letter's suffixes begin; ``larger``: how many of them are larger than their successor.
    """
    n, carry = len(t), lms_shared is not None
    sa = scratch.places(n)
    lcp = scratch.array(n, np.int32) if carry else None
    present = np.flatnonzero(np.diff(starts)).tolist()
    lms_at = np.zeros(letters + 1, np.int64)
    for x, y in stretches(len(lms)):
        lms_at[1:] += np.bincount(t[lms[x:y]], minlength=letters)
    np.cumsum(lms_at, out=lms_at)

    def seam(i: int, j: int) -> int:
        return int(common_prefix(t, np.array([i]), np.array([j]), np.array([1]), cap)[0])

    up = Queues(t, small, False, sa, lcp, starts[:-1], letters, 1, cap)
    for c in present:
        up.new_letter()
        done = int(starts[c])
        while done < (now := min(int(up.next[c]), done + BATCH)):
            up.extract(np.array(sa[done:now]), np.array(lcp[done:now]) if carry else None)
            done = now
        a, b = int(lms_at[c]), int(lms_at[c + 1])
        for x, y in stretches(b - a):
            shared = None
            if carry:
                shared = np.array(lms_shared[a + x : a + y])
                if not x:
                    shared[0] = seam(int(sa[done - 1]), int(lms[a])) if done > starts[c] else 0
            up.extract(np.array(lms[a + x : a + y]), shared)
    down = Queues(t, small, True, sa, lcp, starts[1:] - 1, letters, -1, cap)
    sa[0], down.next[0] = n - 1, -1  # the last letter is the least, and met once
    seams = np.zeros(letters, np.int64)
    for c in reversed(present):
        down.new_letter()
        done, left = int(starts[c + 1]) - 1, int(starts[c] + larger[c])
        if c == 0:
            down.extract(np.array([n - 1]), np.zeros(1, np.int64) if carry else None)
            continue
        while done > (now := max(int(down.next[c]), done - BATCH)):
            down.extract(np.array(sa[now + 1 : done + 1])[::-1], np.array(lcp[now + 1 : done + 1])[::-1] if carry else None)
            done = now
        for x, y in stretches(int(larger[c]), backwards=True):
            x, y = x + int(starts[c]), y + int(starts[c])
            shared = None
            if carry:
                shared = np.zeros(y - x, np.int64)
                shared[1:] = np.array(lcp[x + 1 : y])[::-1]
                if y < left:
                    shared[0] = lcp[y]
                elif left < starts[c + 1]:
                    shared[0] = seams[c] = seam(int(sa[left - 1]), int(sa[left]))
            down.extract(np.array(sa[x:y])[::-1], shared)
    if carry:  # what was pushed downwards is compared with its right neighbour: turn that to the left one
        for c in present:
            left, right = int(starts[c] + larger[c]), int(starts[c + 1])
            if left < right:
                for x, y in stretches(right - left - 1, backwards=True):
                    lcp[left + 1 + x : left + 1 + y] = np.array(lcp[left + x : left + y])
                lcp[left] = seams[c]
            lcp[starts[c]] = 0
    return sa, lcp


def by_doubling(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by doubling ranks, for strings that induction does not shorten."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    width, sa = 1, np.argsort(rank, kind="stable")
    while width <= n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        sa = np.lexsort((second, rank))
        new = np.concatenate([[0], np.cumsum((rank[sa[1:]] != rank[sa[:-1]]) | (second[sa[1:]] != second[sa[:-1]]))])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        width *= 2
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefix(t, sa[:-1], sa[1:], np.zeros(n - 1, np.int64), cap)
    return sa, lcp


def types(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is."""
    n = len(t)
    small, after, letter = scratch.array(n, bool), True, -1  # of what follows the stretch
    for a, b in stretches(n, backwards=True):
        own = np.array(t[a:b])
        ends = np.append(np.flatnonzero(own[1:] != own[:-1]), b - a - 1)  # of runs of one letter
        rises = np.append(own[ends[:-1]] < own[ends[:-1] + 1], after if letter in (-1, int(own[-1])) else int(own[-1]) < letter)
        small[a:b] = np.repeat(rises, np.diff(np.concatenate([[-1], ends])))
        after, letter = bool(small[a]), int(own[0])
    return small


def collected(n: int, of, scratch: Scratch) -> np.ndarray:
    """All that ``of(a, b)`` gives for the stretches of [0, n), one after the other: n / 2 at the utmost."""
    out, at = scratch.places(n // 2 + 1), 0
    for a, b in stretches(n):
        found = of(a, b)
        out[at : at + len(found)] = found
        at += len(found)
    return out[:at]


def by_letter(t: np.ndarray, lms: np.ndarray, letters: int, scratch: Scratch) -> np.ndarray:
    """The LMS suffixes in the order of their first letters."""
    size = np.zeros(letters, np.int64)
    for a, b in stretches(len(lms)):
        size += np.bincount(t[lms[a:b]], minlength=letters)
    to, out = np.cumsum(size) - size, scratch.places(len(lms))
    for a, b in stretches(len(lms)):
        own = np.array(lms[a:b])
        letter = t[own].astype(np.int64)
        order = np.argsort(letter, kind="stable")
        n = np.bincount(letter, minlength=letters)
        out[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(b - a)] = own[order]
        to += n
    return out


def names_of(t: np.ndarray, lms: np.ndarray, rough: np.ndarray, number: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The LMS substrings' names in the order of the text, from their sorted order (``rough``), and how many names there are."""
    reduced, name = scratch.places(len(lms)), -1
    for a, b in stretches(len(rough)):
        low = max(a - 1, 0)  # each is compared with the one before it
        own = np.array(rough[low:b])
        at = number[own]
        size = np.where(at + 1 < len(lms), lms[np.minimum(at + 1, len(lms) - 1)] - own, 0)
        differs = np.ones(len(own), bool)
        on = np.flatnonzero(size[1:] == size[:-1]) + 1
        differs[on] = False
        d = 0
        while len(on):
            bad = t[own[on] + d] != t[own[on - 1] + d]
            differs[on[bad]] = True
            on = on[~bad & (size[on] > d)]
            d += 1
        names = name + np.cumsum(differs[a - low :])
        reduced[at[a - low :]] = names
        name = int(names[-1])
    return reduced, name + 1


def two_digits(reduced: np.ndarray, names: int, scratch: Scratch) -> np.ndarray:
    """Each name as two digits, and a last 0."""
    base = int(np.ceil(np.sqrt(names + 1)))
    digit = scratch.array(2 * len(reduced) + 1, np.uint16)
    for a, b in stretches(len(reduced)):
        digit[2 * a : 2 * b : 2], digit[2 * a + 1 : 2 * b + 1 : 2] = reduced[a:b] // base + 1, reduced[a:b] % base + 1
    digit[-1] = 0
    return digit


def of_names(pairs: np.ndarray, shared: np.ndarray, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of ``n`` names, from those of the digits they are written in."""
    order, same, at, least = scratch.places(n), scratch.places(n), 0, np.iinfo(np.int32).max
    for a, b in stretches(len(pairs)):
        own, common = np.array(pairs[a:b]), np.array(shared[a:b])
        whole = np.flatnonzero((own % 2 == 0) & (own < len(pairs) - 1))
        if not len(whole):
            least = min(least, int(common.min()))
            continue
        got = np.minimum.reduceat(common[: whole[-1] + 1], np.append(0, whole[:-1] + 1))
        got[0] = min(int(got[0]), least)
        order[at : at + len(whole)], same[at : at + len(whole)] = own[whole] // 2, got // 2
        at += len(whole)
        rest = common[whole[-1] + 1 :]
        least = int(rest.min()) if len(rest) else np.iinfo(np.int32).max
    same[0] = 0
    return order, same


def sort_suffixes(t: np.ndarray, cap: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, common prefix of each with its predecessor up to ``cap``).

    ``t``: letters from 0 on; the last one must be 0 and the only 0.
    """
    scratch = scratch or Scratch()
    n = len(t)
    t = t.astype(np.uint16, copy=False)  # letters are bytes, or digits of names
    if n < 3:
        return np.arange(n)[::-1].copy(), np.zeros(n, np.int64)
    letters = int(t.max()) + 1
    small = types(t, scratch)

    def lms_in(a: int, b: int) -> np.ndarray:
        own = np.array(small[max(a - 1, 0) : b])
        return np.flatnonzero(own[1:] & ~own[:-1]) + max(a, 1)

    lms = collected(n, lms_in, scratch)
    size, larger = np.zeros(letters, np.int64), np.zeros(letters, np.int64)
    for a, b in stretches(n):
        size += np.bincount(t[a:b], minlength=letters)
        larger += np.bincount(t[a:b][~small[a:b]], minlength=letters)
    starts = np.concatenate([[0], np.cumsum(size)])
    if len(lms) < 2:
        return induce(t, small, lms, np.zeros(len(lms), np.int64), starts, larger, letters, cap, scratch)

    # Names: LMS substrings (up to and with the next LMS letter), sorted by induction from any order.
    sa, _ = induce(t, small, by_letter(t, lms, letters, scratch), None, starts, larger, letters, cap, scratch)

    def rough_in(a: int, b: int) -> np.ndarray:
        own = np.array(sa[a:b])
        return own[small[own] & (own > 0) & ~small[own - 1]]

    rough = collected(n, rough_in, scratch)
    del sa
    number = scratch.places(n)
    for a, b in stretches(len(lms)):
        number[lms[a:b]] = np.arange(a, b)
    reduced, names = names_of(t, lms, rough, number, scratch)

    # The order of the LMS suffixes is that of the string of names.
    most = cap // 2 + 1  # a name stands for two letters at least
    if names == len(lms):
        order, same = scratch.places(len(lms)), scratch.places(len(lms))
        for a, b in stretches(len(lms)):
            order[a:b] = number[rough[a:b]]
    elif len(reduced) <= SMALL:
        order, same = by_doubling(np.array(reduced), most)
    elif names <= ALPHABET:
        letter = scratch.array(len(reduced), np.uint16)  # the last name is the least, and met once
        for a, b in stretches(len(reduced)):
            letter[a:b] = reduced[a:b]
        order, same = sort_suffixes(letter, most, scratch)
    else:
        digit = two_digits(reduced, names, scratch)
        shorter = len(digit) < 0.9 * n
        pairs, shared = sort_suffixes(digit, 2 * most + 1, scratch) if shorter else by_doubling(digit, 2 * most + 1)
        order, same = of_names(pairs, shared, len(reduced), scratch)
        del digit, pairs, shared
    del rough, number, reduced
    first, common = scratch.places(len(lms)), scratch.array(len(lms), np.int32)
    for a, b in stretches(len(lms)):
        low = max(a - 1, 0)
        place = np.array(order[low:b])
        own = lms[place].astype(np.int64)
        first[a:b] = own[a - low :]
        skip = np.minimum(same[low + 1 : b], len(lms) - 1 - np.maximum(place[1:], place[:-1]))
        known = lms[place[1:] + skip] - own[1:]
        common[low + 1 : b] = common_prefix(t, own[:-1], own[1:], known, cap)
    return induce(t, small, first, common, starts, larger, letters, cap, scratch)
