"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns and always stay. What the patterns miss is
judged by a semi-Markov field over *zones*: number zones (digit groups and the
separators between them) and address zones (words around a written-out or spaced ``@``, with
marks for dots between them). A segment is one or several neighbouring groups, its
score looks at the whole span (number of digits, group lengths, separators,
checksum, sign and brackets; marks, ending and parts of an address; what stands around it), and a dynamic programme
over segments picks boundaries and kinds together. A segment has 19 digits, or 6 domain parts, at the utmost, as no
kind has more. Groups inside base spans are fixed and not judged again.

The field is trained here, by conditional likelihood, on zones of the corpus
with their base spans as labels, each also rewritten in other notations (no
plus sign, other separators, written-out marks), so that it learns the kinds rather than one
notation. The sample is bounded: the ``train_zones`` zones of the smallest
hashes; all texts are then decoded whole.

A null or empty text has no spans. Positions are code points, ends exclusive.
Repeated rows get the same result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import fresh, map_texts

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, tried once in each run of digits.
IP_SCAN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A digit group, and what may stand between groups of one zone.
GROUP = re.compile(r"[0-9]+")
LINK = re.compile(r"[ ().\-/]{1,3}")
MOST_DIGITS = 19  # of any kind
LABELS = ("other", "ip", "card", "phone", "email")
#: Marks of an address: an at sign that is spaced or written out, and a dot.
AT = r"(?:[ ]?[(\[{][ ]?(?:at|AT|At|@)[ ]?[)\]}][ ]?|[ ]@[ ]?|@[ ]|[ ](?:at|AT)[ ])"
DOT = r"(?:[ ]?[(\[{][ ]?(?:dot|DOT|Dot|\.)[ ]?[)\]}][ ]?|[ ](?:dot|DOT)[ ]|[ ]\.[ ]?|\.[ ]?)"
PART = r"[A-Za-z0-9_%+-]{1,64}"
#: Words with marks between them, one of which is an at sign; and what stands in any text that has one.
ADDRESS = re.compile(rf"(?<![A-Za-z0-9_%+-])(?:{PART}{DOT}){{0,3}}+{PART}(?:{AT}|@){PART}(?:{DOT}{PART}){{1,6}}+")
MARKED = r"[ ]@|@[ ]|[(\[{][ ]?(?:at|AT|At|@)[ ]?[)\]}]|[ ](?:dot|DOT)[ ]|[(\[{][ ]?(?:dot|DOT|Dot)[ ]?[)\]}]"
MARK = re.compile(rf"({AT}|@)|{DOT}")
#: Endings that most addresses have.
ENDINGS = frozenset("com org net edu gov mil int io de fr es it uk nl eu us ca au jp cn ru br in info biz example".split())


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    number = digits(text)
    return 16 <= len(number) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 8 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``EMAIL``, found from their @ signs: the scan of a long text without any is not repeated at each place."""
    local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and (text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-")):
            a -= 1
        m = EMAIL.match(text, a) if a < at and local.match(text, a, at) else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind by kind, leftmost first, without overlaps inside a kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for kind, pattern, fits in (("ip", IP_SCAN, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        if kind != "phone" or "+" in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text) if fits(m.group())]
    return out


# --- zones and segments -------------------------------------------------------


class Zone:
    """Neighbouring groups of a text, in order; here those of digits."""

    def __init__(self, text: str, groups: list[tuple[int, int]]) -> None:
        self.text, self.groups = text, groups

    def segments(self, j: int) -> Iterator[int]:
        """Where a segment that ends before group j may begin."""
        n = 0
        for i in range(j - 1, -1, -1):
            n += self.groups[i][1] - self.groups[i][0]
            if n > MOST_DIGITS and i < j - 1:
                return
            yield i

    def plausible(self, i: int, j: int) -> tuple[str, ...]:
        return plausible(self.text, self.groups, i, j)

    def features(self, i: int, j: int) -> list[str]:
        return features(self.text, self.groups, i, j)

    def extent(self, i: int, j: int) -> tuple[int, int]:
        return extent(self.text, self.groups, i, j)


class Address(Zone):
    """Words of a text with marks between them."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.marks = list(MARK.finditer(text, a, b))
        cuts = [a, *(x for m in self.marks for x in m.span()), b]
        super().__init__(text, list(zip(cuts[::2], cuts[1::2], strict=True)))
        self.at = [bool(m.group(1)) for m in self.marks]

    def segments(self, j: int) -> Iterator[int]:
        return iter(range(j - 1, max(-1, j - 12), -1))

    def plausible(self, i: int, j: int) -> tuple[str, ...]:
        if j == i + 1:
            return ("other",)
        inside = self.at[i : j - 1]
        return ("email",) if sum(inside) == 1 and not inside[-1] and "@" not in "".join(self.text[x:y] for x, y in self.groups[i:j]) else ()

    def features(self, i: int, j: int) -> list[str]:
        if j == i + 1:
            return ["a:word"]
        at = i + self.at[i : j - 1].index(True)
        dots = [self.text[m.start() : m.end()].lower() for k, m in enumerate(self.marks[i : j - 1], i) if k != at]
        mark = self.text[self.marks[at].start() : self.marks[at].end()].lower()
        after = dots[at - i :]
        tail = self.text[self.groups[j - 1][0] : self.groups[j - 1][1]]
        out = [
            f"a:at={'bracket' if mark.strip()[0] in '([{' else 'word' if 'a' in mark else 'plain' if mark == '@' else 'sign'}",
            f"a:dots={'+'.join(sorted({'word' if 'o' in d else 'spaced' if d == ' . ' else 'after' if d.endswith(' ') else 'plain' for d in after}))}",
            f"a:tail={'known' if tail.lower() in ENDINGS else 'word' if tail.isalpha() and 2 <= len(tail) <= 6 else 'odd'}",
            f"a:case={'lower' if tail == tail.lower() else 'upper' if tail == tail.upper() else 'title'}",
            f"a:parts={min(len(after), 3)}",
            f"a:before={min(at - i, 2)}",
        ]
        if self.text[self.groups[j - 2][0] : self.groups[j - 2][1]].lower() in ENDINGS and not self.at[j - 2]:
            out.append("a:beyond")
        return out

    def extent(self, i: int, j: int) -> tuple[int, int]:
        return self.groups[i][0], self.groups[j - 1][1]


def zones(text: str, taken: list[tuple[int, int]], least: int = 7) -> Iterator[Zone]:
    """Runs of digit groups outside ``taken`` spans with ``least`` digits in all, as a card or phone has, or with four
    short groups with dots between them."""
    taken = sorted(taken)

    def worth(held: list[tuple[int, int]]) -> bool:
        if sum(y - x for x, y in held) >= least:
            return True
        linked = [y - x <= 3 for x, y in held[:1]] + [q[1] - q[0] <= 3 and "." in text[p[1] : q[0]] for p, q in zip(held, held[1:], strict=False)]
        return any(all(linked[k + 1 : k + 4]) and held[k][1] - held[k][0] <= 3 for k in range(len(held) - 3))

    t, held, last = 0, [], 0
    for m in GROUP.finditer(text):
        a, b = m.span()
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        fixed = t < len(taken) and taken[t][0] < b
        joined = held and not fixed and LINK.fullmatch(text, last, a) and not (t and taken[t - 1][1] > last)
        if held and not joined:
            if worth(held):
                yield Zone(text, held)
            held = []
        if not fixed:
            held.append((a, b))
            last = b
    if held and worth(held):
        yield Zone(text, held)


def addresses(text: str, taken: list[tuple[int, int]]) -> Iterator[Address]:
    """Words with marks between them that are outside ``taken`` spans."""
    taken = sorted(taken)
    t, at = 0, 0
    while m := ADDRESS.search(text, at):
        a, b = m.span()
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        if t < len(taken) and taken[t][0] < b:
            at = max(taken[t][1], a + 1)
            continue
        yield Address(text, a, b)
        at = b


def extent(text: str, groups: list[tuple[int, int]], i: int, j: int) -> tuple[int, int]:
    """Characters of groups i to j - 1, with a plus sign or bracket that belongs to the first."""
    a, b = groups[i][0], groups[j - 1][1]
    body = text[a:b]
    if a and text[a - 1] == "(" and ")" in body:
        a -= 1
    if a and text[a - 1] == "+":
        a -= 1
    return a, b


def features(text: str, groups: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """What the field sees of a segment, as a whole."""
    a, b = extent(text, groups, i, j)
    sizes = [y - x for x, y in groups[i:j]]
    number = "".join(text[x:y] for x, y in groups[i:j])
    between = [text[groups[k][1] : groups[k + 1][0]] for k in range(i, j - 1)]
    shape = "-".join(map(str, sizes)) if len(sizes) > 1 and max(sizes) <= 9 else f"{len(sizes)}x"
    links = set(between)
    link = "none" if not links else next(iter(links)) if len(links) == 1 else "mixed"
    before, after = text[a - 1 : a], text[b : b + 1]
    out = [f"n={min(len(number), 24)}", f"groups={len(sizes)}", f"shape={shape}", f"link={link}"]
    if len(number) in range(13, 20) and luhn(number):
        out.append("luhn")
    if len(sizes) == 4 and links == {"."} and max(sizes) <= 3 and all(int(text[x:y]) <= 255 for x, y in groups[i:j]):
        out.append("octets")
    if text[a : a + 1] == "+":
        out.append("plus")
    if "(" in text[a:b] and ")" in text[a:b]:
        out.append("brackets")
    if before.isalnum() or after.isalnum():
        out.append("glued")
    if i or j < len(groups):
        out.append("part")
    return out


def plausible(text: str, groups: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Kinds that a segment could be of at all: the others have no score."""
    sizes = [y - x for x, y in groups[i:j]]
    n = sum(sizes)
    out = ["other"] if j == i + 1 else []
    if len(sizes) == 4 and max(sizes) <= 3 and all(0 < y - x <= 3 for (_, x), (y, _) in zip(groups[i:j], groups[i + 1 : j], strict=False)):
        out.append("ip")
    if 13 <= n <= 19:
        out.append("card")
    if 7 <= n <= 15 and max(sizes) <= 11:
        out.append("phone")
    return tuple(out)


class Field:
    """Weights of (label, feature) and (label before, label)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def score(self, names: list[str], label: str, before: str) -> float:
        w = self.weights
        return sum(w.get(f"{label}|{x}", 0.0) for x in names) + w.get(f"{before}>{label}", 0.0)

    def decode(self, zone: Zone) -> list[tuple[str, int, int]]:
        """The best cut of the zone into labelled segments; spans of those that are no "other"."""
        groups = zone.groups
        best: list[dict[str, tuple[float, int, str]]] = [{"start": (0.0, -1, "")}]
        for j in range(1, len(groups) + 1):
            here: dict[str, tuple[float, int, str]] = {}
            for i in zone.segments(j):
                kinds = zone.plausible(i, j)
                names = zone.features(i, j) if kinds else []
                for label in kinds:
                    for before, (s, _, _) in best[i].items():
                        value = s + self.score(names, label, before)
                        if label not in here or value > here[label][0]:
                            here[label] = (value, i, before)
            best.append(here)
        label, j, out = max(best[-1], key=lambda k: best[-1][k][0]), len(groups), []
        while j:
            _, i, before = best[j][label]
            if label != "other":
                out.append((label, *zone.extent(i, j)))
            label, j = before, i
        return out[::-1]


def train(examples: list[tuple[str | Zone, list[tuple[str, int, int]]]], steps: int = 40, rate: float = 0.5, penalty: float = 1e-3) -> Field:
    """Gradient ascent on the conditional log-likelihood of the labelled zones (a zone or the text of a number zone, and spans)."""
    lattices = []
    index: dict[str, int] = {}
    number = lambda x: index.setdefault(x, len(index))
    for given, spans in examples:
        zone = given if isinstance(given, Zone) else Zone(given, [m.span() for m in GROUP.finditer(given)])
        groups = zone.groups
        gold, k = [], 0
        while k < len(groups):
            own = [(label, a, b) for label, a, b in spans if a <= groups[k][0] < b]
            upto = k + 1
            label = "other"
            if own:
                label = own[0][0]
                while upto < len(groups) and groups[upto][0] < own[0][2]:
                    upto += 1
            gold.append((label, k, upto))
            k = upto
        edges = []  # (from, to, label, features)
        for j in range(1, len(groups) + 1):
            for i in zone.segments(j):
                names = None
                for label in zone.plausible(i, j):
                    names = zone.features(i, j) if names is None else names
                    edges.append((i, j, label, [number(f"{label}|{x}") for x in names]))
        known = {(i, j, label) for i, j, label, _ in edges}
        if groups and all((i, j, label) in known for label, i, j in gold):
            lattices.append((len(groups), edges, gold))
    moves = {(a, b): number(f"{a}>{b}") for a in ("start", *LABELS) for b in LABELS}
    w = np.zeros(len(index))
    speed = np.full(len(index), 1e-8)
    for _ in range(steps):
        grad = -penalty * w
        for n, edges, gold in lattices:
            grad += _gradient(n, edges, gold, moves, w) / max(1, len(lattices))
        speed += grad * grad
        w += rate * grad / np.sqrt(speed)
    return Field({k: float(w[i]) for k, i in index.items() if w[i]})


def _gradient(n: int, edges: list, gold: list, moves: dict, w: np.ndarray) -> np.ndarray:
    """Features of the labelled cut less those expected under the field (forward and backward sums)."""
    into = [[] for _ in range(n + 1)]
    for e, (_, j, _, _) in enumerate(edges):
        into[j].append(e)
    own = [float(w[f].sum()) for _, _, _, f in edges]
    ahead: list[dict[str, float]] = [{"start": 0.0}] + [{} for _ in range(n)]
    for j in range(1, n + 1):
        sums: dict[str, list[float]] = {}
        for e in into[j]:
            i, _, label, _ = edges[e]
            sums.setdefault(label, []).extend(s + own[e] + w[moves[before, label]] for before, s in ahead[i].items())
        ahead[j] = {k: _lse(v) for k, v in sums.items() if v}
    total = _lse(list(ahead[n].values()))
    back: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(ahead[n], 0.0)]
    grad = np.zeros(len(w))
    held: list[dict[str, list[float]]] = [{} for _ in range(n)]
    for j in range(n, 0, -1):
        if j < n:
            back[j] = {k: _lse(v) for k, v in held[j].items()}
        for e in into[j]:
            i, _, label, f = edges[e]
            if label not in back[j]:
                continue
            for before, s in ahead[i].items():
                inner = own[e] + w[moves[before, label]] + back[j][label]
                p = math.exp(s + inner - total)
                grad[f] -= p
                grad[moves[before, label]] -= p
                if i:
                    held[i].setdefault(before, []).append(inner)
    names = {(i, j, label): f for i, j, label, f in edges}
    before = "start"
    for label, i, j in gold:
        grad[names[i, j, label]] += 1
        grad[moves[before, label]] += 1
        before = label
    return grad


def _lse(values: list[float]) -> float:
    if not values:
        return -math.inf
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def rewritten(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The zone itself, and in other notations of its single labelled span."""
    yield text, spans
    if len(spans) != 1:
        return
    kind, a, b = spans[0]
    number = digits(text[a:b])
    forms = [sep.join(text[a:b].split(".")) for sep in (" . ", ". ", "(.)")] if kind == "ip" else []
    if kind == "card" and len(number) == 16:
        forms = [sep.join(number[i : i + 4] for i in range(0, 16, 4)) for sep in (" ", "-", ".")]
    if kind == "phone" and len(number) == 11:
        c, x, y, z = number[:1], number[1:4], number[4:7], number[7:]
        forms = [f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"{c}-{x}-{y}-{z}", f"{c} {x} {y} {z}", f"+{c}-{x}-{y}-{z}", f"{x} {y} {z}"]
    for form in forms:
        yield text[:a] + form + text[b:], [(kind, a, a + len(form))]


#: Number notations that are no personal data, which a corpus may hold none of.
COUNTEREXAMPLES = (
    "in 1998-1999 it", "in 2010 - 2011 it", "on 2024-01-31 at", "on 31.12.1999 at", "on 31-12-1999 at", "on 12/31/1999 at",
    "of 10 000 000 we", "of 1 234 567 we", "of 250 000 000 we", "is 3.14159265 or", "is 12345.6789 or", "no 12345678 is",
    "see 1. 2. 3. 4. 5. in", "of 1. 2. 3. 4 in", "is 4. 5. 6. 7. 8. so", "in 1 . 2 . 3 . 4 . 5 . 6 of", "no 123456789 is", "no 1234567890123 is", "pp 1234-1256 of", "at 2024-01-31 12 in", "is 1.000.000 of", "is 100.000.000 of",
)


#: Words around marks that are no addresses, which a corpus may hold none of.
OTHER_WORDS = (
    "meet at noon. Then go", "look at that. And this", "was at home . Then", "good at maths. He is", "we stay at sea. No one", "at work at last. So it", "sold @ five. Each of",
    "the mail at work dot matrix", "points at one dot here", "sat at a dot then another dot", "arrive at six. Dinner is", "stop at once . But we", "a look at it.The end",
)


def rewritten_address(local: str, domain: str) -> Iterator[tuple[str, int]]:
    """An address in other notations, and how long each is."""
    for at, dot in ((" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", " . "), (" @ ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " dot "), ("@ ", "."), (" AT ", " DOT ")):
        form = local.replace(".", dot if "dot" in dot.lower() else ".") + at + domain.replace(".", dot)
        yield form, len(form)


def address_examples(mails: list[str]) -> list[tuple[Zone, list[tuple[str, int, int]]]]:
    """Addresses in other notations, also before the next sentence, and words that are none."""
    out = []
    for mail in mails:
        local, _, domain = mail.partition("@")
        for form, n in rewritten_address(local, domain):
            for tail in ("", ". Then we", " . And"):
                m = ADDRESS.match(form + tail)
                if m and m.end() >= n:
                    out.append((Address(form + tail, 0, m.end()), [("email", 0, n)]))
    none = [(Address(text, *m.span()), []) for text in OTHER_WORDS if (m := ADDRESS.search(text))]
    times = max(5, len(out) // (4 * max(1, len(none)))) if out else 0
    return out + none * times


#: Addresses that stand for their notation where a corpus has none.
MAILS = ("jane.doe@mail.com", "info@shop.example.org", "x_7@uni-a.edu", "first.last@news.co.uk", "team@city.de", "a.b.c@site.net")


def training_set(examples: list) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled zones, their other notations, and the counterexamples (as a tenth of all, five each at least)."""
    made = [x for e in examples for x in rewritten(*e)]
    times = max(5, len(made) // (9 * len(COUNTEREXAMPLES))) if made else 0
    return made + [(text, []) for text in COUNTEREXAMPLES] * times + address_examples(list(MAILS))


# --- Spark --------------------------------------------------------------------


def with_digits(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts, "[0-9@]").fill_null(False).to_pylist()


def with_marks(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts, MARKED).fill_null(False).to_pylist()


def zone_examples(docs: DataFrame, text_col: str, n: int, longest: int = 120) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled zones of the ``n`` smallest hashes (zones of up to ``longest`` characters, with what stands around them)."""
    fields = T.StructType([T.StructField("zones", T.ArrayType(T.StringType()))])

    def make():
        def fn(texts: pa.Array) -> list:
            out = []
            for text, any_ in zip(texts.to_pylist(), with_digits(texts), strict=True):
                own = []
                if any_:
                    spans = [s for s in base_spans(text) if s[0] != "email"]
                    avoid = list(emails(text)) if "@" in text else []
                    for z in zones(text, avoid):
                        a, b = max(0, z.groups[0][0] - 3), z.groups[-1][1] + 2
                        inside = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
                        ordered = sorted(inside, key=lambda s: s[1])
                        if b - a <= longest and all(p[2] <= q[1] for p, q in zip(ordered, ordered[1:], strict=False)):
                            own.append(text[a:b] + "\0" + ",".join(f"{k}:{x}:{y}" for k, x, y in ordered))
                out.append(own)
            return [out]

        return fn

    found = map_texts(docs, [], text_col, fields, make).select(F.explode("zones").alias("zone")).distinct()
    rows = found.orderBy(F.xxhash64("zone"), "zone").limit(n).collect()
    out = []
    for r in rows:
        text, _, spans = r.zone.partition("\0")
        out.append((text, [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in spans.split(",") if s)]))
    return out


def find(docs: DataFrame, keep: list[str], *, text_col: str = "text", train_zones: int = 800) -> DataFrame:
    """``keep`` columns, ``base`` and ``added``: arrays of (kind, start, end)."""
    field = train(training_set(zone_examples(docs, text_col, train_zones)))
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    b, a = fresh(keep, "base"), fresh(keep, "added")

    def make():
        model = Field(shared.value)
        rows = lambda spans: [{"kind": k, "start": x, "end": y} for k, x, y in spans]

        def fn(texts: pa.Array) -> list:
            base, added = [], []
            for text, any_, marked in zip(texts.to_pylist(), with_digits(texts), with_marks(texts), strict=True):
                own = base_spans(text) if any_ else []
                taken, more = [s[1:] for s in own], []
                if model.weights:
                    more += [s for z in zones(text, taken) for s in model.decode(z)] if any_ else []
                    more += [s for z in addresses(text, taken + [s[1:] for s in more]) for s in model.decode(z)] if marked else []
                base.append(rows(sorted(own, key=lambda s: (KINDS.index(s[0]), s[1]))))
                added.append(rows(more))
            return [base, added]

        return fn

    return map_texts(docs, keep, text_col, T.StructType([T.StructField(b, span), T.StructField(a, span)]), make)


def report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: base spans by kind, their digest, all spans, and how many these are."""
    found = find(docs, [id_col], **options)
    base, added = found.columns[-2:]
    kind = F.array(*[F.lit(k) for k in KINDS])
    n_of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    ranked = F.array_sort(
        F.transform(F.concat(base, added), lambda s: F.struct(F.array_position(kind, s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return found.select(
        id_col,
        *[n_of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.col(base)), 256).alias("base_sha256"),
        text(ranked).alias("spans"),
        F.size(ranked).cast("bigint").alias("n_spans"),
    )
