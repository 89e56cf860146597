"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint per text; two texts link if their fingerprints differ in
at most ``distance`` bits. The fingerprint is cut into the fewest segments for
which one of them must differ by at most one bit (``distance // 2 + 1``), and
each segment is indexed once for every bit position with that bit replaced by
a wildcard: such a pair has equal variants of one segment.

1. Equal fingerprints are one class (pre-aggregated before any shuffle), so
   exact copies, however many, cost one row.
2. Classes are dealt by variant and sorted. Each task reads its variants as
   sorted runs and verifies bit distances there. It does not give out a run's
   pairs: a run of n classes is joined up by at most n - 1 verified links, and
   one task gives out at most a spanning forest of all classes it saw.
3. Links become components (``components``), components the smallest document
   id of all their classes.

A run longer than ``run_limit`` is not held in one task: its classes get finer
variants in a further round, of the bits that its key leaves free (which
differ by no more than ``distance`` bits either, so this is as exact). After
two such rounds a key fixes over 40 bits.

Texts of no words have fingerprint zero and link like any other. Null text:
no words. Null ids come after all others: a component is named null only if
none of its documents has an id. Repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import as_bytes, discard, fresh, map_texts, store
from ledgerlens.llm.components import components

SPACED = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
BITS = 64
SHORT = 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle of a text, repeats included."""
    words = text.translate(SPACED).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :].tolist()
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def make():
        def fn(texts: pa.Array) -> list:
            fps = np.array([majority(shingle_hashes(x, shingle)) for x in as_bytes(texts)], np.uint64)
            return [pa.array(fps.view(np.int64))]

        return fn

    return map_texts(docs, keep, text_col, T.StructType([T.StructField(fresh(keep, "fp"), T.LongType())]), make)


def one_wildcard(mask: int, distance: int) -> list[int]:
    """Masks of the variants of all bits outside ``mask``, each with the bits of ``mask`` as well.

    The bits outside are cut into the fewest segments of which one differs by
    at most one bit; a variant keeps one segment without one of its bits.
    """
    free = [b for b in range(BITS) if not mask >> b & 1]
    n = distance // 2 + 1
    cuts = [len(free) * i // n for i in range(n + 1)]
    out = []
    for x, y in zip(cuts, cuts[1:], strict=False):
        whole = sum(1 << b for b in free[x:y])
        out += [mask | whole & ~(1 << b) for b in free[x:y]]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(fp, distance: int):
    """(mask, part): the fixed bits of every one-wildcard variant, and their values."""
    masks = [F.lit(signed(m)).cast("bigint") for m in one_wildcard(0, distance)]
    return F.array(*[F.struct(m.alias("mask"), fp.bitwiseAND(m).alias("part")) for m in masks])


def finer_variants(rows: DataFrame, distance: int) -> DataFrame:
    """The same for classes (mask, fp) that already share the bits of ``mask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for m in np.unique(mask).tolist():
                if m not in known:
                    known[m] = np.array([signed(x) for x in one_wildcard(m & (1 << 64) - 1, distance)], np.int64)
                masks, own = known[m], fp[mask == m]
                for at in range(0, len(own), 1 << 14):  # some 2 ** 20 variants at a time
                    some = own[at : at + (1 << 14)]
                    cols = [np.tile(masks, len(some)), (some[:, None] & masks).ravel(), np.repeat(some, len(masks))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["mask", "part", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask bigint, part bigint, fp bigint")


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance  # of signed numbers it counts the absolute value


#: Classes of a run that are compared in one task; longer runs are cut by further variants.
RUN_LIMIT = 1 << 12


class Forest:
    """Union-find over the classes that a task has seen."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def tie(self, x: int, y: int) -> bool:
        """True if x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def run_links(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Verified links that join up all near classes of one run: at most one a class."""
    left = fps
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            hit = near(left, edge[0], distance)
            if hit.any():
                got = left[hit]
                for x in got.tolist():
                    yield int(edge[0]), x
                edge, left = np.concatenate([edge[1:], got]), left[~hit]
            else:
                edge = edge[1:]


LINKS = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "mask", "part")])


def run_link_rows(variant_rows: DataFrame, distance: int, run_limit: int | None) -> DataFrame:
    """(a, b): verified links inside the runs of equal (mask, part); (mask, part) alone: a run of more than
    ``run_limit`` classes, which was left as it is."""
    dealt = variant_rows.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[np.ndarray] = []  # of the run that the last batch ended in
        size_held, key = 0, None
        out: list[tuple[int | None, ...]] = []

        def tie(pairs) -> None:
            out.extend((a, b, None, None) for a, b in pairs if forest.tie(a, b))

        def close() -> None:
            if run_limit and size_held > run_limit:
                out.append((None, None, *key))
            elif held:
                tie(run_links(np.concatenate(held), distance))

        for batch in batches:
            mask, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.append(new, len(fp))
            if key != (int(mask[0]), int(part[0])):
                close()
                held, size_held, key = [], 0, (int(mask[0]), int(part[0]))
            size_held += int(ends[0])
            held = [*held, fp[: ends[0]].copy()] if not run_limit or size_held <= run_limit else []
            if len(starts) > 1:  # the run held so far is over; the batch's last run is held next
                close()
                key, size_held = (int(mask[-1]), int(part[-1])), int(ends[-1] - starts[-1])
                held = [fp[starts[-1] :].copy()]
                starts, ends = starts[1:-1], ends[1:-1]
                size = ends - starts
                short = size <= SHORT
                for off in range(1, int(size[short].max(initial=1))):  # short runs: all offsets at once
                    wide = np.flatnonzero(short & (size > off))
                    first = np.repeat(starts[wide], size[wide] - off) + _ramp(size[wide] - off)
                    ok = near(fp[first], fp[first + off], distance)
                    tie(zip(fp[first[ok]].tolist(), fp[first[ok] + off].tolist(), strict=True))
                for i in np.flatnonzero(~short):
                    if run_limit and size[i] > run_limit:
                        out.append((None, None, int(mask[starts[i]]), int(part[starts[i]])))
                    else:
                        tie(run_links(fp[starts[i] : ends[i]], distance))
            if out:
                yield _rows(out)
                out.clear()
        close()
        if out:
            yield _rows(out)

    return dealt.mapInArrow(run, LINKS)


def variant_links(classes: DataFrame, distance: int, run_limit: int, finer: int = 2) -> DataFrame:
    """(a, b): verified links between classes ``fp``, enough to join up every component."""
    rows = classes.select("fp", F.explode(variants(F.col("fp"), distance)).alias("v")).select("v.mask", "v.part", "fp")
    links = []
    for step in range(finer + 1):
        found = store(run_link_rows(rows, distance, run_limit if step < finer else None), "variant-links")
        links.append(found.filter("a is not null").select("a", "b"))
        long = found.filter("a is null").select("mask", "part").distinct()
        if step == finer or long.isEmpty():
            break
        finer_rows = store(finer_variants(rows.join(long, ["mask", "part"]), distance), "finer-variants")
        if step:
            discard(rows)
        rows = finer_rows
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=LINKS.names)


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, run_limit: int) -> DataFrame:
    """(id, row, fp, least): of each document, its id and text hash, fingerprint, and the first document of its component."""
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    prints = store(fingerprints(src, ["id", "row"], "text", shingle), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row"))
    classes = store(prints.groupBy("fp").agg(first.alias("least")), "classes")
    groups = components(variant_links(classes, distance, run_limit))
    placed = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("least"))
    of = placed.select("fp", "component").join(least, "component").select("fp", "least")
    return prints.join(of, "fp")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, run_limit: int = RUN_LIMIT
) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits) and component_id (the smallest id of its component)."""
    placed = _placed(docs, id_col, text_col, shingle, distance, run_limit)
    return placed.select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.id").alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, run_limit: int = RUN_LIMIT
) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest id (of rows that
    share it, that of the smallest text hash; of rows equal in both, any one)."""
    placed = _placed(docs, id_col, text_col, shingle, distance, run_limit)
    i, r, n = (fresh(docs.columns, x) for x in ("kept_id", "kept_row", "row_number"))
    same = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("row") == F.col("least.row"))
    first = placed.filter(same).select(F.col("id").alias(i), F.col("row").alias(r)).distinct()
    row = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    rows = docs.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (row == F.col(r)), "left_semi")
    one = Window.partitionBy(f"`{id_col}`", row).orderBy(F.lit(0))
    return rows.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).drop(n)
