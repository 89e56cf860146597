"""Personal data: base spans against the plain patterns, added spans on notations that the patterns miss."""

from __future__ import annotations

import hashlib
import re

import pytest
from helpers import awkward, by_id, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import pii

ORDER = ["email", "ip", "card", "phone"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (ORDER.index(s[0]), s[1]))


TEXTS = [
    "mail a.b+c@mail7.example.com, a@b@c.d a@b.c@d.e @x.y x@y é@z.fr ü.a@z.fr",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 1.2.3 " + "9" * 5000 + ".1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 41111111111111110 4111  1111",
    "+1 (974) 555-3436, +12 +1234567 +1234567890123456 ++15551234567 +1.555.123.4567.",
]


def test_base_spans_equal_the_patterns(spark):
    texts = TEXTS + awkward(["call", "+1 (974) 555-3436", "me@x.org", "now"])
    got = by_id(pii.report(documents(spark, texts)))
    for i, text in enumerate(texts):
        want = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in ORDER]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined.split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (ORDER.index(s.split(":")[0]), int(s.split(":")[1])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1@.-+é %", max_size=25))
def test_emails_equal_the_pattern(text):
    assert list(pii.emails(text)) == [(a, b) for k, a, b in plain(text) if k == "email"]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789. -+()x", max_size=40))
def test_other_kinds_equal_the_patterns(text):
    got = sorted(pii.base_spans(text), key=lambda s: (ORDER.index(s[0]), s[1]))
    assert got == plain(text)


@pytest.fixture(scope="module")
def field():
    phones = [(f"to +1 ({a}) 555-{b} x", [("phone", 3, 20)]) for a, b in zip(range(200, 260), range(1000, 1060), strict=True)]
    cards = []
    for n in range(4_000_000_000_000_000, 4_000_000_000_000_600):
        if luhn(str(n)):
            cards.append((f"is {n} y", [("card", 3, 19)]))
    others = [(f"no {n} z", []) for n in (980791576280, 4736962573099581, 47369625, 1234567, 9876543210123) for _ in range(6)]
    ips = [(f"at 10.{a}.20.{a + 1}, b", [("ip", 3, 14)]) for a in range(10, 60)]
    return pii.train(pii.training_set(phones + cards + others + ips))


def decode(field, text):
    own = [s[1:] for s in pii.base_spans(text)]
    return [(k, text[a:b]) for z in pii.zones(text, own) for k, a, b in field.decode(z)]


def test_added_spans(field):
    assert decode(field, "call (974) 555-3436 now") == [("phone", "(974) 555-3436")]
    assert decode(field, "call 974-555-3436 or 974.555.9999") == [("phone", "974-555-3436"), ("phone", "974.555.9999")]
    assert decode(field, "card 4000.0000.0000.0002 ok") == [("card", "4000.0000.0000.0002")]


def test_clean_numbers_are_left_alone(field):
    for text in ("page 12 of 345", "in 1998-1999", "total 980791576280 sold", "id 47369625 end", "no digits at all", "on 2003-04-05 at", "10 000 000 of them"):
        assert decode(field, text) == []
    assert decode(field, "+1 (974) 555-3436") == []  # a base span is not judged again


def test_decoding_is_the_best_cut(field):
    """The dynamic programme against every cut of a short zone."""
    text = "x 974 555-3436 12 10.1.2.3 x"
    zone = next(pii.zones(text, []))
    groups = zone.groups

    def best(i, before):
        if i == len(groups):
            return 0.0
        return max(
            (
                field.score(pii.features(text, groups, i, j), k, before) + best(j, k)
                for j in range(i + 1, len(groups) + 1)
                for k in pii.plausible(text, groups, i, j)
            ),
            default=float("-inf"),
        )

    spans = field.decode(zone)
    value, before, i = 0.0, "start", 0
    while i < len(groups):
        own = next((s for s in spans if s[1] <= groups[i][0] < s[2]), None)
        j = i + 1
        while own and j < len(groups) and groups[j][0] < own[2]:
            j += 1
        k = own[0] if own else "other"
        value += field.score(pii.features(text, groups, i, j), k, before)
        before, i = k, j
    assert value == pytest.approx(best(0, "start"))


def test_empty_table_and_clashing_names(spark):
    assert pii.report(documents(spark, []).limit(0)).count() == 0
    docs = documents(spark, ["me@x.org"]).withColumnRenamed("lang", "base").withColumnRenamed("source", "added")
    found = pii.find(docs, docs.columns).collect()[0]
    assert found["base"] == "en" and found["_base"][0]["kind"] == "email"


@pytest.mark.parametrize("text", ["9" * 1_000_000, "1." * 500_000, "9" * 400_000 + ".1.1.1 " + "8" * 400_000, "7 " * 20_000, "+1" * 200_000, "a@" * 200_000, "x at " * 100_000])
def test_long_runs_take_seconds(text, field):
    import time

    begun = time.process_time()
    own = pii.base_spans(text)
    for z in [*pii.zones(text, [s[1:] for s in own]), *pii.addresses(text, [s[1:] for s in own])]:
        field.decode(z)
    assert time.process_time() - begun < 20
    begun = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - begun < 5


def test_long_runs_have_the_spans_of_the_patterns():
    for text in ("9" * 3000 + ".1.2.3", "1." * 300, "10.1.1." + "2" * 999 + ".3", "0" * 500 + "1.2.3.4x"):
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == [s for s in plain(text) if s[0] == "ip"]


def marked(field, text):
    own = [s[1:] for s in pii.base_spans(text)]
    return [(k, text[a:b]) for z in pii.addresses(text, own) for k, a, b in field.decode(z)]


def test_addresses_in_other_notations(field):
    """Planted addresses of names the field was not trained on: recall, and where each ends."""
    found = total = 0
    for local, domain in (("mary.smith", "post.org"), ("k9_x", "lab.example.net"), ("office", "firm.it"), ("ann", "school.edu"), ("p.q.r", "a-b.co.uk")):
        for form, _ in pii.rewritten_address(local, domain):
            for before, after in (("Write to ", " today."), ("", ""), ("or: ", ". Thanks")):
                total += 1
                found += ("email", form) in marked(field, before + form + after)
    assert found / total > 0.9


def test_words_around_marks_are_left_alone(field):
    texts = ["We meet at noon. Then we go", "he sat at home . But", "two @ five. Each", "look at this. Come in", "the dot at the end. Of it", "plain words", "at 5 . 6 . 7", "a@b.com"]
    assert [marked(field, t) for t in texts] == [[]] * len(texts)


def test_short_ips_in_other_notations(field):
    assert decode(field, "host 10 . 0 . 0 . 1 is up") == [("ip", "10 . 0 . 0 . 1")]
    assert decode(field, "host 10. 0. 0. 7, ok") == [("ip", "10. 0. 0. 7")]
    assert decode(field, "host 192(.)168(.)1(.)20 ok") == [("ip", "192(.)168(.)1(.)20")]
    for text in ("see 1. 2. 3. 4. 5. 6. of it", "on 31. 12. 1999 at", "in 1. 2. 3. of"):
        assert decode(field, text) == []


def test_cards_of_many_groups(field):
    text = "pay 4 0 0 0 0 0 0 0 0 0 0 0 0 0 0 2 now"
    zone = next(pii.zones("pay " + "-.-".join("4000000000000002") + " now", []))
    assert len(zone.groups) == 16 and 0 in set(zone.segments(16))
    assert pii.base_spans(text) == [("card", 4, 35)]


def test_added_spans_of_a_whole_table(spark):
    """The query's spans are the base ones and what the field adds; none of them overlaps a base one."""
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = contract.queries()["op6_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        added = [s for s in spans if s not in base]
        assert len(spans) == len(base) + len(added)
        assert all(b <= x or y <= a for _, a, b in added for _, x, y in base)
