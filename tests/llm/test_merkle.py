"""Merkle manifest against a plain tree; proofs are folded by a plain verifier."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from ledgerlens.llm import merkle

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, **other):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return digest("".join(part({**row, **other}[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree, i, fanout):
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // fanout * fanout :][:fanout]
        out.append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        i //= fanout
    return out


def fold(x, steps):
    for at, others in steps:
        x = digest("".join([*others[:at], x, *others[at:]]))
    return x


def first_null(v):
    return (v is not None, v.encode() if isinstance(v, str) else v or 0)


def brute(rows, fanout=16):
    """(id, leaf, path, subroot, root, forged leaf) of every row."""
    found = [(r["source"], r["doc_id"], leaf(r), r) for r in rows]
    sources = sorted({f[0] for f in found}, key=first_null)
    own = {s: sorted((f for f in found if f[0] == s), key=lambda f: (first_null(f[1]), f[2])) for s in sources}
    trees = {s: levels([f[2] for f in own[s]], fanout) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for i, (_, key, x, row) in enumerate(own[s]):
            forged = x
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and row["text"] is not None:
                forged = leaf(row, text=row["text"].translate(UP))
            out.append((key, x, path(trees[s], i, fanout) + path(top, k, fanout), trees[s][-1][0], top[-1][0], forged))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def check(spark, docs, fanout=16):
    want = brute([r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()], fanout)
    got = merkle.verified(docs, suspect=merkle.tampered(), forged={"text": merkle.lowered()})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    plain = [(k, x, sub, root, digest("".join(o for _, s in p for o in s)), fold(f, p), fold(f, p) == root) for k, x, p, sub, root, f in want]
    assert order(map(tuple, got.collect())) == order(plain)
    proofs = [(r.doc_id, r.leaf, tuple((s["at"], tuple(s["others"])) for s in r.path), r.subroot, r.root) for r in merkle.manifest(docs).collect()]
    assert order(proofs) == order((k, x, tuple((a, tuple(o)) for a, o in p), sub, root) for k, x, p, sub, root, _ in want)
    assert all(fold(x, p) == root for _, x, p, _, root in proofs)


def test_awkward_rows(spark):
    rows = documents(spark, [*enumerate(awkward(["Alpha", "bÉta"])), (3, "same id"), (3, "Same id"), (None, "no id"), (None, None), (7, "Twin"), (7, "Twin")])
    rows = rows.withColumn("source", F.when(F.col("doc_id") % 4 == 1, None).when(F.col("doc_id") == 2, "").when(F.col("doc_id") == 4, "é").otherwise(F.col("source")))
    check(spark, rows.selectExpr("*", "1 as g", "'x' as leaf", "2 as place", "3 as n", "'y' as root", "4 as block", "5 as id", "6 as part"))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257])
def test_trees_of_odd_sizes(spark, n):
    check(spark, documents(spark, [(i, f"Text {i}") for i in range(n)]).withColumn("source", F.lit("one")))


@pytest.mark.parametrize(("n", "sources"), [(700, 1), (300, 40), (90, 90)])
def test_many_butterfly_rounds(spark, monkeypatch, n, sources):
    """Blocks of two leaves and runs of two: as many rounds as levels, short subtrees in most of them."""
    monkeypatch.setattr(merkle, "FANOUT", 2)
    monkeypatch.setattr(merkle, "LIFT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 2)
    docs = documents(spark, [(i, f"Text {i}") for i in range(n)])
    check(spark, docs.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") * F.col("doc_id")) % sources)), 2)


@pytest.mark.parametrize("n", [1, 3, 16, 17, 33, 100])
def test_a_round_of_blocks(spark, monkeypatch, n):
    """Every block learns the root and all siblings; blocks that stand in for others add no rows."""
    held = spark.range(n).selectExpr("'s' as g", "id as block", f"{n}L as n_blocks", "sha2(cast(cast(id as string) as binary), 256) as root", f"cast(array() as array<{merkle.STEP}>) as path")
    start = {r.block: r.root for r in held.collect()}
    tree = levels([start[i] for i in range(n)], 16)
    rows = merkle.butterfly(held).collect()
    assert sorted(r.block for r in rows) == list(range(n))
    for r in rows:
        assert r.root == tree[-1][0]
        assert [(s["at"], s["others"]) for s in r.path] == path(tree, r.block, 16)


def test_a_changed_row_changes_the_root_and_fails(spark):
    docs = documents(spark, [(i, f"Text {i}") for i in range(60)])
    root = {r.root for r in merkle.manifest(docs).collect()}
    other = docs.withColumn("text", F.when(F.col("doc_id") == 31, "text 31").otherwise(F.col("text")))
    assert len(root) == 1 and root != {r.root for r in merkle.manifest(other).collect()}
    found = merkle.verified(docs, suspect=F.col("doc_id") == 31, forged={"text": F.lit("text 31")}).collect()
    assert [r.doc_id for r in found if not r.verified] == [31]


def test_empty_table(spark):
    nothing = documents(spark, [])
    assert merkle.verified(nothing).collect() == [] and merkle.manifest(nothing).collect() == []
