"""Helpers shared by the text operators.

``map_texts`` runs a vectorised function over the texts of a table in
Arrow batches of bounded size; ``store`` cuts lineage with a Parquet table in
the shared folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.sources.sinks import checkpoint_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\x0c\r"


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or what stands for it (tests)."""
    return checkpoint_root(spark)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``store`` wrote for these tables: their successors are written, and no plan reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` where a text is plain ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def visible_text(html: Column) -> Column:
    """What a page shows: no tags, scripts, styles, comments and entities. A tag ends at its first ``>``; what follows a
    ``<`` without any is no text."""
    parts = F.split(F.concat(F.lit(">"), html.cast("string")), "<")

    def shown(x: Column) -> Column:
        hidden = F.lower(F.substring(x, 1, 6)).rlike("^(script|style|!--)")
        comment = F.when(F.instr(x, "-->") > 0, F.substring_index(x, "-->", -1)).otherwise(F.lit(""))
        after = F.when(F.instr(x, ">") > 0, F.substring(x, F.instr(x, ">") + 1, F.length(x))).otherwise(F.lit(""))
        return F.when(hidden, F.when(x.startswith("!--"), comment).otherwise(F.lit(""))).otherwise(after)

    return F.regexp_replace(F.array_join(F.transform(parts, shown), " "), "&#?[a-zA-Z0-9]{1,8};", " ")


def chunks(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]
            room = ends[at] + max(0, max_bytes - size)
            upto = max(at + 1, int(np.searchsorted(ends, room, "right")) - 1)
            upto = min(upto, batch.num_rows)
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto] - ends[at])
            at = upto
            if size >= max_bytes:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]


def map_texts(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[pa.Array], list]],
    max_bytes: int = 16 << 20,
    pass_text: bool = False,
) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields`` computed from the texts.

    ``make()`` runs once per task and returns a function from an Arrow array
    of texts (null as null) to a list of columns in the order of ``fields``.
    ``fields`` must not clash with ``keep``.
    """
    text = fresh(df.columns, "text_in")
    src = df.select(F.col(text_col).cast("string").alias(text), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*(src.schema[c] for c in keep), *fields.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in chunks(batches, 0, max_bytes):
            made = fn(b.column(0))
            cols = [b.column(i + 1) for i in range(len(keep))] + [
                c if isinstance(c, pa.Array) else pa.array(c, arrow.field(len(keep) + i).type) for i, c in enumerate(made)
            ]
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow
            )

    return src.mapInArrow(run, schema)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
