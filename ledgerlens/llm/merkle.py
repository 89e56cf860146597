"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf: the digest of its fields. The leaves of a group (source)
ascend by id and form a tree of ``FANOUT`` children a node; the groups' roots, in
order of the groups, form another one up to the root of the dataset.

1. Leaves are hashed where they are read, once. They are dealt by range of (group,
   id) and numbered within their partition; running counts per group over the partitions
   give each leaf's place in its group, so a hot group is spread over many tasks.
2. ``FANOUT ** LIFT`` leaves whose places are aligned are a *block*, and each block
   hashes its own subtree.
3. Butterfly rounds: in round r the blocks whose numbers differ in one digit only (base
   ``FANOUT``, digit r) swap the roots of the subtrees they stand in, and each of them hashes the same
   parent from what it got. After as many rounds as the group has levels every block has the
   group's root and all siblings on its way there; nothing is passed down. Where the last
   subtree of a run has fewer blocks than the others, its blocks stand in for the missing ones.
4. The groups' roots are leaves of the upper tree, which takes the same rounds; a block gets the
   upper part of its path by an equality join on its group (a row per block, not per leaf).
5. Blocks meet their leaves again, and each leaf's path is the block's plus what is inside the block.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex
text. A node with one child is the digest of that child; a single leaf is its tree's
root. Null fields count as ``-``, others as UTF-8 byte count, ``:`` and value, so
null and empty differ. A null group is a group by itself and comes first; a null id
comes first in its group. Rows of equal id go by their leaf; repeated rows are
leaves of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.llm.common import ascii_lower, discard, store

FANOUT, LIFT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a path: the node's place in its run, and the others of the run.
STEP = "struct<at:int,others:array<string>>"
ROWS = 4096  # rows that are put out at a time


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


# --- places -------------------------------------------------------------------


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, id, leaf, ...) with ``place`` in their group (from 0) and the group's size ``n``."""
    order = [F.asc_nulls_first("g"), F.asc_nulls_first("id"), F.asc("leaf")]
    ranges = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ranges.schema.fields, T.StructField("nth", T.LongType())])
    arrow, at = to_arrow_schema(schema), ranges.columns.index("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for b in batches:
            nth = []
            for g in b.column(at).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64())], schema=arrow)

    dealt = store(ranges.mapInArrow(run, schema), "merkle-places")
    parts = dealt.groupBy("g", "part").agg(F.count("*").alias("c"))
    own = Window.partitionBy("g")  # at most a row per partition of the table
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select(F.col("g").alias("og"), F.col("part").alias("op"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(own).alias("n"))
    same = F.col("g").eqNullSafe(F.col("og")) & (F.col("part") == F.col("op"))
    return dealt.join(offset, same).select(*leaves.columns, (F.col("nth") + F.col("before")).alias("place"), "n")


# --- trees --------------------------------------------------------------------


def lifted(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level over ``digests``, ``levels`` times."""
    out = [digests]
    for _ in range(levels):
        out.append([sha("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def inner_levels(n: int) -> int:
    """Levels of a group's tree that lie inside its blocks."""
    levels = 0
    while n > 1 and levels < LIFT:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def step(run: list[str], at: int) -> dict:
    return {"at": at, "others": run[:at] + run[at + 1 :]}


def inner_path(levels: list[list[str]], i: int) -> list[dict]:
    """The steps of leaf ``i`` of a block up to the block's root."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % FANOUT
        out.append(step(nodes[first : first + FANOUT], i % FANOUT))
        i //= FANOUT
    return out


def climb(digest: str, path: list[dict]) -> str:
    """The root that a leaf and its path give."""
    for s in path:
        digest = sha("".join([*s["others"][: s["at"]], digest, *s["others"][s["at"] :]]))
    return digest


BLOCK = FANOUT**LIFT


def blocks(leaves: DataFrame) -> DataFrame:
    """(g, block, n_blocks, root, path): every block's root; its path is empty yet."""
    dealt = leaves.select("g", (F.col("place") / BLOCK).cast("bigint").alias("block"), "place", "n", "leaf")
    dealt = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "place")
    schema = T.StructType([dealt.schema["g"], T.StructField("block", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("root", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for (g, block), members in groupby(rows, lambda r: r[:2]):
            own = list(members)  # FANOUT ** LIFT rows at most
            n = own[0][3]
            out.append((g, block, -(-n // BLOCK), lifted([r[4] for r in own], inner_levels(n))[-1][0]))
            if len(out) >= ROWS:
                yield record(out, arrow)
                out = []
        yield record(out, arrow)

    return dealt.mapInArrow(run, schema).withColumn("path", F.array().cast(f"array<{STEP}>"))


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def exchanged(held: DataFrame, r: int) -> DataFrame:
    """One butterfly round: blocks that differ in digit ``r`` swap roots, and all hash their parent."""
    width = FANOUT**r  # blocks of a full subtree
    node = F.floor(F.col("block") / width).cast("bigint")
    low, digit = (F.col("block") % width).cast("bigint"), (node % FANOUT).cast("int")
    size = F.least(F.lit(width).cast("bigint"), F.col("n_blocks") - node * width)  # blocks of this subtree
    # Where a subtree is short of blocks, those it has stand in for the others, in turn.
    last = F.when(digit == 0, low).otherwise(F.lit(width - 1).cast("bigint"))
    seats = held.withColumns({"digit": digit, "low": low, "parent": F.floor(node / FANOUT).cast("bigint")})
    seats = seats.select("*", F.explode(F.sequence(low, last, size)).alias("seat"))
    member = F.struct("digit", "root", "block", "n_blocks", "path", (F.col("seat") == F.col("low")).alias("real"))
    met = seats.groupBy("g", "parent", "seat").agg(F.sort_array(F.collect_list(member)).alias("run"))  # FANOUT at most
    roots = F.transform("run", lambda m: m["root"])
    met = met.withColumn("parent_root", F.sha2(F.array_join(roots, "").cast("binary"), 256))
    others = F.transform(F.filter("run", lambda o: o["digit"] != F.col("m.digit")), lambda o: o["root"])
    taken = F.struct(F.col("m.digit").alias("at"), others.alias("others")).cast(STEP)
    return met.select("g", "run", "parent_root", F.explode(F.filter("run", lambda m: m["real"])).alias("m")).select(
        "g", F.col("m.block").alias("block"), F.col("m.n_blocks").alias("n_blocks"), F.col("parent_root").alias("root"),
        F.concat("m.path", F.array(taken)).alias("path"),
    )


def butterfly(held: DataFrame) -> DataFrame:
    """``blocks`` after all rounds: ``root`` is the group's, ``path`` leads there from the block."""
    held = store(held, "merkle-blocks")
    most = held.agg(F.max("n_blocks")).first()[0] or 1
    done, r = [], 0
    while FANOUT**r < most:
        left = F.col("n_blocks") > FANOUT**r
        done.append(held.filter(~left))
        held = store(exchanged(held.filter(left), r), "merkle-round")  # the last round's other blocks are read later
        r += 1
    for d in done:
        held = held.unionByName(d)
    return held


def with_paths(leaves: DataFrame, held: DataFrame, extra: list[str], fields: list[T.StructField], make) -> DataFrame:
    """``extra`` columns of ``leaves`` (placed) and what ``make(row, path, block)`` gives from each leaf's whole path.

    ``held`` (g, block, root, path, ...) goes before the leaves of its block in one sorted stream.
    """
    own_cols = list(enumerate(["n", "leaf", *extra]))
    tops = F.struct(*[c for c in held.columns if c not in ("g", "block")]).alias("top")
    top = held.select("g", "block", F.lit(-1).cast("bigint").alias("place"), tops, *[F.lit(None).cast(leaves.schema[c].dataType).alias(f"x{i}") for i, c in own_cols])
    no_top = F.lit(None).cast(top.schema["top"].dataType).alias("top")
    low = leaves.select("g", (F.col("place") / BLOCK).cast("bigint").alias("block"), "place", no_top, *[F.col(c).alias(f"x{i}") for i, c in own_cols])
    stream = low.unionByName(top).repartition("g", "block").sortWithinPartitions("g", "block", "place")
    schema = T.StructType([leaves.schema["g"], *(leaves.schema[c] for c in extra), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for (g, _), members in groupby(rows, lambda r: r[:2]):
            held = next(members)[3]
            own = list(members)  # FANOUT ** LIFT rows at most
            levels = lifted([r[5] for r in own], inner_levels(own[0][4]))
            for i, r in enumerate(own):
                out.append((g, *r[6:], *make(r[5], r[6:], inner_path(levels, i) + held["path"], held)))
                if len(out) >= ROWS:
                    yield record(out, arrow)
                    out = []
        yield record(out, arrow)

    return stream.mapInArrow(run, schema)


# --- the operator -------------------------------------------------------------


def _placed_with_tops(docs: DataFrame, id_col: str, group_col: str, fields: tuple[str, ...], suspect: Column | None, forged: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    own = leaf([F.col(f"`{c}`") for c in fields])
    other = leaf([forged.get(c, F.col(f"`{c}`")) for c in fields]) if forged else F.lit(None).cast("string")
    leaves = docs.select(
        F.col(f"`{group_col}`").alias("g"), F.col(f"`{id_col}`").alias("id"), own.alias("leaf"),
        (other if suspect is None else F.when(suspect, other)).alias("forged"),
    )
    hashed = store(leaves, "merkle-hashed")
    leaves = store(placed(hashed), "merkle-leaves")
    discard(hashed)
    held = store(butterfly(blocks(leaves)), "merkle-groups")
    # The upper tree: its leaves are the groups' roots.
    subroots = held.filter("block = 0").select(F.lit(0).alias("g"), F.col("g").alias("id"), F.col("root").alias("leaf"))
    upper = store(placed(subroots), "merkle-subroots")
    tops = butterfly(blocks(upper))

    def whole(digest: str, row: tuple, path: list[dict], top: dict) -> tuple:
        return top["root"], path

    steps = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))]))
    above = with_paths(upper, tops, ["id"], [T.StructField("top_root", T.StringType()), T.StructField("top_path", steps)], whole)
    above = above.select(F.col("id").alias("of"), "top_root", "top_path")
    joined = held.join(above, held["g"].eqNullSafe(above["of"]))
    return leaves, joined.select("g", "block", F.col("root").alias("subroot"), F.col("top_root").alias("root"), F.concat("path", "top_path").alias("path"))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row: its id, ``leaf``, the ``path`` (place and siblings per level), ``subroot`` and ``root``."""
    leaves, held = _placed_with_tops(docs, id_col, group_col, fields, None, {})
    path = T.StructField("path", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))])))
    out = [path, T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())]
    rows = with_paths(leaves, held, ["id", "leaf"], out, lambda digest, row, path, top: (path, top["subroot"], top["root"]))
    return rows.select(F.col("id").alias(id_col), "leaf", "path", "subroot", "root")


def verified(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    suspect: Column | None = None,
    forged: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (digest of all siblings on its path), and
    ``folded_root``: what the path gives from the leaf of the row as it is found, that is with the
    ``forged`` columns in place of its own where it is ``suspect``. ``verified``: it is the root."""
    leaves, held = _placed_with_tops(docs, id_col, group_col, fields, suspect, forged or {})

    def proof(digest: str, row: tuple, path: list[dict], top: dict) -> tuple:
        folded = climb(row[2] or digest, path)
        return top["subroot"], top["root"], sha("".join(x for s in path for x in s["others"])), folded, folded == top["root"]

    out = [T.StructField(c, T.StringType()) for c in ("subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())]
    rows = with_paths(leaves, held, ["id", "leaf", "forged"], out, proof)
    return rows.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered(id_col: str = "doc_id") -> Column:
    """Rows that the registered query tampers with: those whose id's CRC-32 five divides."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def lowered(text_col: str = "text") -> Column:
    return ascii_lower(F.col(f"`{text_col}`").cast("string"))
