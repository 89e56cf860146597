"""Line deduplication with DataFrame functions only.

Lines are told by a 128-bit hash of their key (stripped, A-Z lower-cased).
Hashes are dealt by range (equal ranges of a uniform hash need no sampling
pass) and sorted by hash, document and position, so the first occurrence is
whatever comes first in its sorted run, and is taken in passing. What comes
back is not text but, per document, a run-length coded bitmap of lines kept.

A line that a third of all documents hold must not meet in one task, so a
hash's rows are also dealt over ``salts`` blocks of documents. In each block
all but the first document's lines are dropped at once; the first documents
of all blocks (``salts`` at most per line) are then compared in a second pass
by hash alone.

Null or empty texts are one empty line. A null id sorts before all others.
Rows are told apart by id and text, so repeated rows are one document and get
the same result; rows of one id with different texts are parts of one document.
Lines with a key under ``min_chars`` code points always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, ascii_lower, fresh

RANGES = 4096


def line_keys(text: Column) -> Column:
    """Of each line, the key: stripped of blanks at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, salts: int) -> DataFrame:
    """(id, row hash, pos) of every line to drop."""
    text = F.col(text_col).cast("string")
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(line_keys(text)).alias("pos", "key")
    ).filter(F.char_length("key") >= min_chars)
    hashed = lines.select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("block"),
        "id",
        "row",
        "pos",
    )
    width = (1 << 64) // RANGES
    ranged = hashed.withColumn("range", F.shiftrightunsigned("h1", width.bit_length() - 1).cast("int")).repartition("range", "block")
    # The dealing above serves this window: it is clustered by (range, block).
    in_block = Window.partitionBy("range", "block", "h1", "h2").orderBy(F.col("id").asc_nulls_first())
    order = ranged.withColumn("nth", F.dense_rank().over(in_block))
    later = order.filter("nth > 1").select("id", "row", "pos")
    firsts = order.filter("nth = 1").drop("nth")
    over_all = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_first())
    second = firsts.withColumn("nth", F.dense_rank().over(over_all)).filter("nth > 1").select("id", "row", "pos")
    return later.unionByName(second)


def keep_bitmaps(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = 1024
) -> DataFrame:
    """(id, row, drops) of each document that loses lines. ``drops`` is its bitmap, run-length coded:
    the runs (first line, number of lines) to drop, in order; all other lines are kept."""
    lost = dropped_lines(docs, id_col, text_col, min_chars, salts)
    per = lost.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    starts = F.filter("pos", lambda x, i: (i == 0) | (F.get("pos", i - 1) != x - 1))
    ends = F.filter("pos", lambda x, i: (i == F.size("pos") - 1) | (F.get("pos", i + 1) != x + 1))
    runs = F.transform(F.arrays_zip(F.col("starts"), F.col("ends")), lambda r: F.struct(r["starts"].alias("first"), (r["ends"] - r["starts"] + 1).alias("n")))
    return per.withColumns({"starts": starts, "ends": ends}).select("id", "row", runs.alias("drops"))


def kept_text(text: Column, drops: Column) -> Column:
    """The text without the lines of its bitmap."""
    lines = F.split(text, "\n")
    end = lambda r: r["first"] + r["n"]
    before = F.transform(
        drops,
        lambda r, i: F.slice(
            lines,
            F.when(i == 0, F.lit(0)).otherwise(end(F.get(drops, i - 1))) + 1,
            r["first"] - F.when(i == 0, F.lit(0)).otherwise(end(F.get(drops, i - 1))),
        ),
    )
    last = end(F.element_at(drops, -1))
    tail = F.slice(lines, last + 1, F.size(lines) - last)
    return F.when(drops.isNull(), text).otherwise(F.array_join(F.flatten(F.concat(before, F.array(tail))), "\n"))


def with_bitmaps(docs: DataFrame, keep: list[str], *, id_col: str, text_col: str, **options) -> tuple[DataFrame, str]:
    """``keep`` columns of every document and its bitmap (null: all lines kept); the bitmap's column name."""
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options)
    i, r, d = (fresh(docs.columns, n) for n in ("drop_id", "drop_row", "drops"))
    named = bitmaps.select(F.col("id").alias(i), F.col("row").alias(r), F.col("drops").alias(d))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(r))
    return docs.select(*[F.col(f"`{c}`") for c in keep]).join(named, same, "left").drop(i, r), d


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: lines before dropping, lines dropped, and the digest of what is left."""
    rows, d = with_bitmaps(docs, [id_col, text_col], id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return rows.select(
        id_col,
        F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.aggregate(d, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept_text(text, F.col(d)), 256).alias("kept_sha256"),
    )


def drop_duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All documents and columns, the text without its dropped lines (null texts stay null)."""
    rows, d = with_bitmaps(docs, docs.columns, id_col=id_col, text_col=text_col, **options)
    return rows.withColumn(text_col, kept_text(F.col(text_col), F.col(d))).drop(d)
