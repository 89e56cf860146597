"""Language identification: accuracy on texts whose labels it did not see, and the fused priors by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helpers import awkward, by_id, documents
from pyspark.sql import functions as F

from ledgerlens.llm import langid as l

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 200")
    hidden = F.pmod("doc_id", F.lit(4)) == 0
    seen = docs.withColumn("lang", F.when(~hidden, F.col("lang")))
    got = l.identify(seen, ["doc_id"]).join(docs, "doc_id").filter(hidden)
    right, n = got.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97
    assert got.filter("not kept").count() == 0


def test_clean_documents_stay_and_unreadable_ones_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = documents(spark, [(10_000 + i, t) for i, t in enumerate([None, "", "12 34", "ᚠᚢᚦ ᚨᚱᚲ ᚷᚹᚺ ᚾᛁᛃ ᛇᛈᛉ ᛊᛏᛒ " * 40])])
    both = docs.unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    left = l.keep_identified(both)
    assert left.columns == both.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_trigrams_are_those_around_letters():
    key, n = l.trigrams([b"ab", b"", "é".encode(), b"1 2", b"A"])
    assert n.tolist() == [2, 0, 2, 0, 1] and len(key) == 5
    assert key[4] == l.trigrams([b"a"])[0][0]
    assert len(set(key.tolist())) == 5


def test_host_prior_is_smoothed_level_by_level(spark):
    rows = [("a.x.com", 0)] * 8 + [("b.x.com", 1)] * 2 + [("c.org", 1)] * 5
    decided = spark.createDataFrame(rows, "host string, best int")
    got = {r.host: r.prior for r in l.host_priors(decided, 3, 4.0).collect()}
    n = np.array([8, 7, 0])
    everything = (n + 1) / (15 + 3)
    suffix = (np.array([8, 2, 0]) + 4 * everything) / 14
    domain = (np.array([8, 2, 0]) + 4 * suffix) / 14
    host = (np.array([0, 2, 0]) + 4 * domain) / 6
    assert got["b.x.com"] == pytest.approx(host.tolist())
    assert all(sum(p) == pytest.approx(1) for p in got.values())


def test_the_host_settles_what_the_text_leaves_open(spark):
    lines = {"aa": "aba abba baab abab " * 6, "bb": "cdc cddc dccd cdcd " * 6}
    rows = [(i, t, k, f"{k}.example.com") for k, t in lines.items() for i in range(30)]
    rows += [(100, "x", None, "aa.example.com"), (101, "x", None, "bb.example.com"), (102, "x", "bb", "aa.example.com")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = by_id(l.identify(docs.filter("doc_id >= 0"), ["doc_id"]))
    assert (got[100].language, got[101].language) == ("aa", "bb")
    assert got[102].language == "bb"  # what the markup declares is stronger here than the host


def test_pages_declare_in_their_markup(spark):
    html = ["<html lang='EN-us'>", '<!DOCTYPE html>\n<HTML dir=ltr lang=de>', "<html>", None, "<body lang=fr>"]
    df = spark.createDataFrame([(h,) for h in html], "h string").select(l.declared_language(F.col("h")).alias("d"))
    assert [r.d for r in df.collect()] == ["en", "de", None, None, None]
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumns({"lang": l.declared_language(F.col("html")), "text": F.regexp_replace("html", "<[^>]*>", " ")})
    got = l.identify(pages, ["page_id", "lang"], host=l.url_host(F.col("url")))
    assert got.filter("language = lang").count() > 0.95 * pages.count()


def test_awkward_and_empty_tables(spark):
    docs = documents(spark, awkward(["some", "words", "of", "text"])).withColumnRenamed("n_chars", "scores")
    got = by_id(l.identify(docs, ["doc_id", "scores"]))
    assert sorted(i for i, r in got.items() if not r.kept) == [0, 1, 2, 9]
    assert all(0 < r.posterior <= 1 and not math.isnan(r.posterior) for r in got.values())
    assert l.identify(docs.limit(0), ["doc_id"]).count() == 0
    undeclared = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.language, r.kept) for r in l.identify(undeclared, ["doc_id"]).collect()} == {(None, True)}
    assert l.keep_identified(undeclared).count() == docs.count()


def _with_rare_languages(spark):
    """Two common languages, two rare ones (own script, Latin script) and one with a single row."""
    rnd = random.Random(5)
    words = {
        "en": "the of and to in that was his with as for had you not be her is but at on".split(),
        "fr": "le de la et les des en un du une que est pour qui dans par plus pas au sur".split(),
        "el": "και το της να του με για από που δεν είναι στην στο τον αυτό μας όταν ήταν".split(),
        "fi": "että hän olla joka minä mutta niin kuin kaikki myös vain sitten jälkeen yli".split(),
        "th": "และ ที่ เป็น ของ ไม่ ใน ได้ มี การ จะ ให้ ว่า ไป มา กับ นี้ คน".split(),
    }
    rows = []
    for lang, n in {"en": 400, "fr": 300, "el": 20, "fi": 20, "th": 1}.items():
        rows += [(len(rows) + i, " ".join(rnd.choices(words[lang], k=60)), lang, f"src{i % 3}") for i in range(n)]
    # Not declared, or declared wrongly.
    rows += [(9000, " ".join(rnd.choices(words["el"], k=60)), None, "src0"), (9001, " ".join(rnd.choices(words["fi"], k=60)), None, "src1")]
    rows += [(9002, " ".join(rnd.choices(words["fi"], k=60)), "el", "src1"), (9003, " ".join(rnd.choices(words["en"], k=60)), "fi", "src1")]
    rows += [(9004, "ᚠᚢᚦ ᚨᚱᚲ ᚷᚹᚺ " * 40, None, "src0"), (9005, None, "el", "src0")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_rare_languages_have_models(spark, monkeypatch, block):
    monkeypatch.setattr(l, "BLOCK", block)
    docs = _with_rare_languages(spark)
    common, rare = l.languages(docs, "lang", 0.1, 5)
    assert common == ["en", "fr"] and rare == [("el", 22), ("fi", 21)]
    got = by_id(l.identify(docs, ["doc_id", "lang"], min_share=0.1, min_rows=5))
    assert {i for i, r in got.items() if not r.kept} == {9004, 9005}
    assert {i for i, r in got.items() if i < 9000 and r.language != r.lang} == set()
    assert [got[i].language for i in range(9000, 9005)] == ["el", "fi", "fi", "en", None]


def test_rows_of_unmodelled_languages_stay(spark):
    docs = _with_rare_languages(spark)
    left = {r.doc_id for r in l.keep_identified(docs, min_share=0.1, min_rows=10_000).collect()}
    own_script = {r.doc_id for r in docs.filter("lang in ('el', 'th') and text is not null").collect()}
    assert own_script <= left and 9004 not in left


def test_only_rare_languages(spark):
    docs = _with_rare_languages(spark).filter("lang in ('el', 'fi')")
    got = by_id(l.identify(docs, ["doc_id", "lang"], min_share=2.0, min_rows=5))
    assert {i for i, r in got.items() if i < 9000 and r.language != r.lang} == set()


def plain_identify(rows, known, weight=20.0):
    """The fused posterior of (text, declared, host) rows, step by step; no rare languages."""
    keys = [l.trigrams([(t or "").encode()])[0].tolist() for t, _, _ in rows]
    counts = {k: {} for k in known}
    for key, (_, declared, _) in zip(keys, rows, strict=True):
        for x in key if declared in known else []:
            counts[declared][x] = counts[declared].get(x, 0) + 1
    total = {k: sum(counts[k].values()) + 0.5 * l.BUCKETS for k in known}
    scores = [[sum(math.log((counts[k].get(x, 0) + 0.5) / total[k]) for x in key) / 3 for k in known] + [-len(key) * math.log(l.BUCKETS) / 3] for key in keys]
    classes = len(known) + 1
    best = [s.index(max(s)) for s in scores]
    told = [i for i, key in enumerate(keys) if key]
    share = [[1.0] * classes for _ in known]
    for i in told:
        if rows[i][1] in known:
            share[known.index(rows[i][1])][best[i]] += 1
    column = [sum(r[c] for r in share) for c in range(classes)]
    hosts = [(h or "").lower() for _, _, h in rows]

    def smoothed(inside, parent, w):
        n = [sum(1 for i in told if inside(hosts[i]) and best[i] == c) for c in range(classes)]
        return [(x + w * p) / (sum(n) + w) for x, p in zip(n, parent, strict=True)]

    def suffix(h):
        return h.rsplit(".", 1)[1] if "." in h else ""

    def domain(h):
        return ".".join(h.split(".")[-2:]) if h.count(".") > 1 else h

    out = []
    for i, (_, declared, _) in enumerate(rows):
        h = hosts[i]
        prior = [1.0 / classes] * classes
        if h in {hosts[j] for j in told}:
            prior = smoothed(lambda x: True, prior, classes)
            prior = smoothed(lambda x: suffix(x) == suffix(h), prior, weight)
            prior = smoothed(lambda x: (suffix(x), domain(x)) == (suffix(h), domain(h)), prior, weight)
            prior = smoothed(lambda x: x == h, prior, weight)
        evidence = [math.log(x / c) for x, c in zip(share[known.index(declared)], column, strict=True)] if declared in known else [0.0] * classes
        log = [s + math.log(p) + e for s, p, e in zip(scores[i], prior, evidence, strict=True)]
        top = max(log)
        out.append((log.index(top), 1 / sum(math.exp(x - top) for x in log), bool(keys[i])))
    return out


def test_the_fused_posterior_equals_a_plain_version(spark):
    rnd = random.Random(11)
    words = {"en": "the of and to in that was his".split(), "fr": "le de la et les des en un".split(), "de": "der die und in den von zu das".split()}
    hosts = ["a.x.com", "b.x.com", "x.com", "c.org", "HOST", "", None]
    rows = []
    for _ in range(240):
        lang = rnd.choice(list(words))
        text = " ".join(rnd.choices(words[lang], k=rnd.choice([1, 2, 3, 12])))
        rows.append((text, rnd.choice([lang, lang, None, "fr"]), rnd.choice(hosts[: 4 if lang == "en" else 7])))
    rows += [(None, "en", "a.x.com"), ("12 34", None, "c.org"), ("", "fr", None), ("zq", "de", "never.seen.net"), ("zq", "de", "never.seen.net")]
    rows += [("qzx wvk jjq " * 9, "xx", "c.org"), ("der die das", "xx", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string")
    got = by_id(l.identify(docs, ["doc_id"], min_share=0.1, min_rows=10_000))
    known = ["de", "en", "fr"]
    for i, (best, posterior, told) in enumerate(plain_identify(rows, known)):
        r = got[i]
        assert r.posterior == pytest.approx(posterior, abs=2e-4), i
        unmodelled = best == 3 and rows[i][1] == "xx"
        assert r.language == ((rows[i][1] if unmodelled else [*known, None][best]) if told else None), i
        assert r.kept == (told and (best < 3 or unmodelled))


def test_scores_of_rare_languages_equal_dense_tables(spark):
    docs = _with_rare_languages(spark).selectExpr("doc_id", "text", "lang", "case lang when 'el' then 0 when 'fi' then 1 when 'th' then 2 end as own")
    rare = [("el", 22), ("fi", 21), ("th", 1)]
    name = l.rare_models(docs, rare)
    rows = docs.collect()
    dense = np.full((3, l.BUCKETS), 0.5)
    for r in rows:
        if r.own is not None:
            np.add.at(dense[r.own], l.trigrams([(r.text or "").encode()])[0], 1)
    dense = np.log(dense / dense.sum(1, keepdims=True))
    texts = [(r.text or "").encode() for r in rows if r.text]
    key, n = l.trigrams(texts)
    want = np.array([[dense[j][k].sum() for j in range(3)] for k in np.split(key, np.cumsum(n)[:-1])])
    models = l.RareModels(name, 3)
    for most in (1, 5000, 1 << 22):
        got = np.concatenate([x for _, x in models.scores(key, n, most)])
        assert np.allclose(got, want, atol=1e-2, rtol=1e-5)


def test_the_query_reads_both_tables(spark):
    import __spark_entry__ as contract

    small = "/root/testdata/sf0.001"
    rows = contract.queries()["op5_language_id"](spark, small).collect()
    docs, pages = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "pages"))
    assert sorted(r.doc_id for r in rows if r.table == "documents") == sorted(r.doc_id for r in docs.collect())
    assert sorted(r.doc_id for r in rows if r.table == "pages") == sorted(r.page_id for r in pages.collect())
    declared = {r.page_id: r.d for r in pages.select("page_id", l.declared_language(F.col("html")).alias("d")).collect()}
    assert sum(r.language == declared[r.doc_id] for r in rows if r.table == "pages") > 0.95 * len(declared)


def test_names_that_clash_stay(spark):
    docs = documents(spark, ["some words here", None]).selectExpr("doc_id", "text", "lang", "source", "'mine' as language", "1 as kept", "2 as posterior")
    got = l.identify(docs, ["doc_id", "language", "kept", "posterior"]).collect()
    assert all((r.language, r.kept, r.posterior) == ("mine", 1, 2) and "_language" in r.asDict() and "_kept" in r.asDict() for r in got)
