"""Language identification by Bayesian fusion of evidence.

For every text the languages (and ``und``, no known language) are weighed by

* the text: log-likelihood of its letters under a trigram model per language,
  trained here on the counts of *all* rows that declare a language;
* the declared markup language: P(declared | language), from a grouped count
  of declared against text-only decisions;
* the address: a prior per host, smoothed towards its domain, that towards
  its suffix, that towards all rows (grouped counts of text-only decisions,
  each level counting as ``weight`` rows of the level above).

Common languages are the declared values that at least ``min_share`` of the declaring
rows carry, so there are at most 1 / min_share of them; that bounds all tables
that are broadcast (trigram tables, counts per language). Every other value that at
least ``min_rows`` rows carry is a rare language: its trigrams are counted in a
distributed table, and a file that tasks map lists, trigram by trigram, the rare languages that
have it, so neither memory nor the time of a text grows with languages that share no trigrams
with it (the driver holds their names and one block of the file).
The rare languages are one class of the host prior and of the declared evidence;
within it each weighs by its rows, and a text is weighed under every one of them.
Host tables stay distributed and are joined, never collected.

A text is kept if a known language is likelier than ``und``. A declared value with
fewer rows than ``min_rows`` has no model: where its text is likelier under no other language,
the declaration is all that is known, so it is the language given and the text is kept.
Texts without letters (null, empty, digits only) cannot be told and are not kept. With no
modelled language nothing is known: no language is given and
everything is kept. Null host: the empty host. Null declared language: no
evidence. Repeated rows get the same result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.llm.common import as_bytes, chunks, fresh, shared_folder, store

BUCKETS = 1 << 16
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
#: A byte lies in three trigrams, so each trigram counts a third.
TEMPER = 1 / 3
#: Cells of the file of rare languages that the driver writes at a time.
BLOCK = 1 << 20


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram around a letter, and how many each text has."""
    line = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    low = np.frombuffer(LETTERS, np.uint8)[line]
    middle = low[1:-1]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size + 1) - 1
    use = middle != 32
    upto = np.concatenate([[0], np.cumsum(use)])
    n = upto[np.minimum(end, len(use))] - upto[end - size]
    at = np.flatnonzero(use)
    key = low[at].astype(np.uint32) | middle[at].astype(np.uint32) << 8 | low[at + 2].astype(np.uint32) << 16
    return (key * np.uint32(2654435761)) >> np.uint32(16), n


def declared_language(html: Column) -> Column:
    """The language that a page's markup declares, in lower case, without region; null if none."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))


def languages(docs: DataFrame, declared_col: str, min_share: float, min_rows: int) -> tuple[list[str], list[tuple[str, int]]]:
    """The common languages, and the rare ones with their rows."""
    rows = docs.filter(F.col(declared_col).isNotNull()).groupBy(F.col(declared_col).cast("string").alias("d")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = max(1, math.ceil(min_share * total))
    found = rows.filter(F.col("n") >= min(often, min_rows)).collect()
    return sorted(r.d for r in found if r.n >= often), sorted((r.d, r.n) for r in found if r.n < often)


def trigram_tables(docs: DataFrame, text_col: str, declared_col: str, known: list[str], smoothing: float = 0.5) -> np.ndarray:
    """log P(bucket | language), a row per language and a last, even one for ``und``."""
    number = {d: i for i, d in enumerate(known)}
    src = docs.select(F.col(text_col).cast("string"), F.col(declared_col).cast("string")).filter(F.col(declared_col).isin(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(number) * BUCKETS, np.int64)
        for b in chunks(batches, 0, 4 << 20):
            key, n = trigrams(as_bytes(b.column(0)))
            lang = np.fromiter((number[x] for x in b.column(1).to_pylist()), np.int64, b.num_rows)
            counts += np.bincount(np.repeat(lang, n) * BUCKETS + key, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    cells = src.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(known) * BUCKETS)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(len(known), BUCKETS) + smoothing
    tables = np.log(counts / counts.sum(1, keepdims=True))
    return np.concatenate([tables, np.full((1, BUCKETS), -math.log(BUCKETS))])


def numbered(spark: SparkSession, rare: list[tuple[str, int]]) -> DataFrame:
    """(rare_name, number) of the rare languages."""
    return spark.createDataFrame([(d, i) for i, (d, _) in enumerate(rare)], "rare_name string, number int")


CELL = np.dtype([("number", np.int32), ("gain", np.float32)])


def rare_models(src: DataFrame, rare: list[tuple[str, int]], smoothing: float = 0.5) -> str:
    """A file that every executor fetches; its name. It lists, bucket by bucket, the rare languages that have the bucket
    and how much likelier it is there than a bucket that the language lacks: log P(bucket | language) is
    ``base`` of the language plus that.

    ``src``: text, own (number of the rare language declared). The driver holds ``BLOCK`` cells of the file at a time.
    """
    spark = src.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 0, 4 << 20):
            key, n = trigrams(as_bytes(b.column(0)))
            cell, times = np.unique(np.repeat(b.column(1).to_numpy(), n) * BUCKETS + key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell // BUCKETS), pa.array(cell % BUCKETS), pa.array(times)], names=["number", "bucket", "n"])

    cells = src.filter("own is not null").select("text", F.col("own").cast("bigint")).mapInArrow(run, "number bigint, bucket bigint, n bigint")
    cells = store(cells.groupBy("number", "bucket").agg(F.sum("n").alias("n")), "rare-trigrams")
    total = np.zeros(len(rare))
    for r in cells.groupBy("number").agg(F.sum("n").alias("n")).collect():  # a row per language
        total[r.number] = r.n
    size = np.zeros(BUCKETS, np.int64)
    for r in cells.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # a row per bucket
        size[r.bucket] = r.n
    at = np.concatenate([[0], np.cumsum(size)])
    name = f"rare-languages-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(at.tobytes() + np.log(smoothing / (total + smoothing * BUCKETS)).tobytes()))
    cuts = np.unique(np.concatenate([np.searchsorted(at, np.arange(0, at[-1] + BLOCK, BLOCK)), [BUCKETS]]))
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = cells.filter(F.col("bucket").between(int(low), int(high) - 1)).orderBy("bucket", "number").toPandas()
        made = np.zeros(len(part), CELL)
        made["number"], made["gain"] = part["number"], np.log((part["n"] + smoothing) / smoothing)
        out.write(bytearray(made.tobytes()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class RareModels:
    """The fetched file, memory-mapped. A text costs as much as its trigrams are shared by languages, however many there are."""

    def __init__(self, name: str, n: int) -> None:
        raw = np.memmap(SparkFiles.get(name), np.uint8, "r")
        head = 8 * (BUCKETS + 1)
        self.n, self.at = n, np.frombuffer(raw, np.int64, BUCKETS + 1)
        self.base = np.frombuffer(raw, np.float64, n, head)
        self.cells = np.frombuffer(raw, CELL, int(self.at[-1]), head + 8 * n)

    def scores(self, key: np.ndarray, n: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
        """Log-likelihood of texts of ``n`` trigrams each (``key``) under every rare language, some texts at a time:
        (first text, a row per text)."""
        owner = np.repeat(np.arange(len(n)), n)
        kind, times = np.unique(owner * BUCKETS + key, return_counts=True)
        owner, key = kind // BUCKETS, kind % BUCKETS
        size = self.at[key + 1] - self.at[key]
        work = np.concatenate([[0], np.cumsum(np.bincount(owner, size, len(n)) + self.n)])
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(work, work[first] + most, "right")) - 1)
            a, b = np.searchsorted(owner, [first, last])
            place = np.repeat(self.at[key[a:b]] - (np.cumsum(size[a:b]) - size[a:b]), size[a:b]) + np.arange(int(size[a:b].sum()))
            found = self.cells[place]
            where = np.repeat((owner[a:b] - first) * self.n, size[a:b]) + found["number"]
            gain = np.bincount(where, np.repeat(times[a:b], size[a:b]) * found["gain"], (last - first) * self.n).reshape(-1, self.n)
            yield first, n[first:last, None] * self.base + gain
            first = last


def text_scores(docs: DataFrame, keep: list[str], text_col: str, tables: np.ndarray, rare: list[tuple[str, int]], models: str | None) -> DataFrame:
    """``keep`` columns (``own`` is one), ``n_letters``, and ``scores``: the tempered log-likelihood per class.

    With rare languages their class is the one before ``und``: its score is that of its likeliest language, the
    language's share of the class included; ``rare`` is that language, ``own_score`` the score of the one declared.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables.astype(np.float32))
    rows_of = np.array([n for _, n in rare], float)
    weights = docs.sparkSession.sparkContext.broadcast(np.log(rows_of / rows_of.sum()) if rare else None)
    src = docs.select(F.col(text_col).cast("string").alias("text_in"), *keep)
    at_own = 1 + keep.index("own")
    fields = [T.StructField("n_letters", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))]
    fields += [T.StructField("rare", T.IntegerType()), T.StructField("own_score", T.DoubleType())]
    schema = T.StructType([*(src.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.ascontiguousarray(shared.value)
        share = weights.value
        mapped = None if models is None else RareModels(models, len(share))
        width = len(rows) + (mapped is not None)
        for b in chunks(batches, 0, 4 << 20):
            key, n = trigrams(as_bytes(b.column(0)))
            out = np.zeros((len(n), width))
            some = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[some]
            best, own_score = np.zeros(len(n), np.int32), np.zeros(len(n))
            own = b.column(at_own).fill_null(-1).to_numpy(zero_copy_only=False)

            def likelihood(row: np.ndarray, key=key, starts=starts) -> np.ndarray:
                return np.add.reduceat(row[key].astype(np.float64), starts) * TEMPER

            if len(some):
                for i, row in enumerate(rows[:-1]):
                    out[some, i] = likelihood(row)
                out[some, -1] = likelihood(rows[-1])
                if mapped is not None:
                    for first, made in mapped.scores(key, n[some]):
                        got, texts = made * TEMPER + share, some[first : first + len(made)]
                        best[texts] = got.argmax(1)
                        out[texts, -2] = got.max(1)
                        own_score[texts] = got[np.arange(len(texts)), np.maximum(own[texts], 0)]
            scores = pa.ListArray.from_arrays(np.arange(0, len(n) * width + 1, width, dtype=np.int32), pa.array(out.ravel()))
            cols = [*(b.column(1 + i) for i in range(len(keep))), pa.array(n), scores, pa.array(best), pa.array(own_score, mask=own < 0)]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return src.mapInArrow(run, schema)


def _best(a: str) -> Column:
    return F.array_position(F.col(a), F.array_max(a)).cast("int") - 1


def _counts(df: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Rows per class (column ``n``, one place per class) of each key; from rows of class ``best`` or of counts ``n``."""
    one = (lambda i: F.sum(F.get("n", F.lit(i)))) if "n" in df.columns else (lambda i: F.sum((F.col("best") == i).cast("bigint")))
    return df.groupBy(*keys).agg(F.array(*[one(i) for i in range(classes)]).alias("n"))


def _smooth(n: str, parent: str, weight: float) -> Column:
    total = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.zip_with(n, parent, lambda x, p: (x + weight * p) / (total + weight))


def host_priors(decided: DataFrame, classes: int, weight: float) -> DataFrame:
    """(host, prior): each host's share of classes, smoothed level by level."""
    hosts = _counts(decided, ["host"], classes)
    labels = F.split("host", r"\.")
    hosts = hosts.withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit("")))
    hosts = hosts.withColumn("domain", F.when(F.size(labels) > 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.col("host")))
    domains = _counts(hosts, ["suffix", "domain"], classes)
    suffixes = _counts(domains, ["suffix"], classes)
    everything = _counts(suffixes, [], classes).withColumn("even", F.array_repeat(F.lit(1.0 / classes), classes)).select(_smooth("n", "even", classes).alias("p"))
    suffixes = suffixes.crossJoin(F.broadcast(everything)).select("suffix", _smooth("n", "p", weight).alias("p"))  # one row
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", _smooth("n", "p", weight).alias("p"))
    return hosts.join(domains, ["domain", "suffix"]).select("host", _smooth("n", "p", weight).alias("prior"))


def declared_given_language(decided: DataFrame, known: list[str], rare: int, smoothing: float = 1.0) -> tuple[np.ndarray, float]:
    """P(declared | class): a row per common language and, with rare languages, one for them; and the share of texts in a
    rare language declaring a rare one that declare that very one."""
    same = (F.col("best") == len(known)) & (F.col("rare") == F.col("own"))
    place = F.when(F.col("own").isNull(), F.col("declared"))
    seen = decided.filter(F.col("declared").isin(known) | F.col("own").isNotNull()).groupBy(place.alias("d"), "best", F.coalesce(same, F.lit(False)).alias("same"))
    pool = 1 if rare else 0
    n = np.full((len(known) + pool, len(known) + pool + 1), smoothing)
    hit = all_ = 0
    for r in seen.agg(F.count("*").alias("n")).collect():
        n[len(known) if r.d is None else known.index(r.d), r.best] += r.n
        if r.d is None and r.best == len(known):
            hit, all_ = hit + r.same * r.n, all_ + r.n
    return n / n.sum(0, keepdims=True), (hit + smoothing) / (all_ + 2 * smoothing)


def identify(
    docs: DataFrame,
    keep: list[str],
    *,
    text_col: str = "text",
    declared_col: str = "lang",
    host: Column | None = None,
    min_share: float = 0.001,
    min_rows: int = 20,
    weight: float = 20.0,
) -> DataFrame:
    """``keep`` columns, ``language`` (null: und), ``posterior`` of the likeliest class, and ``kept``.

    ``host``: the address' host (default: the column ``source``). A ``keep`` column that is called like one of these
    stays; the new one gets underscores before its name.
    """
    language, posterior, kept = (fresh(keep, c) for c in ("language", "posterior", "kept"))
    host = F.col("source") if host is None else host
    spark = docs.sparkSession
    d, h = fresh(docs.columns, "declared_in"), fresh(docs.columns, "host_in")
    src = docs.withColumns({d: F.col(declared_col).cast("string"), h: F.coalesce(F.lower(host.cast("string")), F.lit(""))})
    known, rare = languages(docs, declared_col, min_share, min_rows)
    if not known and not rare:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias(language), F.lit(0.0).alias(posterior), F.lit(True).alias(kept))
    tables = trigram_tables(docs, text_col, declared_col, known)
    pool = len(known)  # the class of the rare languages, if there are any
    classes = len(known) + (1 if rare else 0) + 1
    own = {c: f"k{i}" for i, c in enumerate(keep)}
    src = src.select(F.col(text_col).alias("text"), F.col(d).alias("declared"), F.col(h).alias("host"), *[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    models = None
    if rare:
        names = numbered(spark, rare)
        src = src.join(names.select(F.col("rare_name").alias("declared"), F.col("number").alias("own")), "declared", "left")
        models = rare_models(src, rare)
    else:
        src = src.withColumn("own", F.lit(None).cast("int"))
    scored = store(text_scores(src, ["declared", "own", "host", *own.values()], "text", tables, rare, models), "language-scores")
    scored = scored.withColumn("best", _best("scores"))
    decided = scored.filter("n_letters > 0")
    share, same = declared_given_language(decided, known, len(rare))
    even = F.array_repeat(F.lit(0.0), classes)
    evidence = even
    if known:
        tie = F.create_map(*[x for i, k in enumerate(known) for x in (F.lit(k), F.array(*[F.lit(math.log(v)) for v in share[i]]))])
        evidence = F.coalesce(F.element_at(tie, F.col("declared")), even)
    if rare:  # one of the rare languages is declared: the others of them share what is not that very one
        each = share[pool] / len(rare)
        each[pool] = share[pool][pool] * (1 - same) / max(1, len(rare) - 1)
        evidence = F.when(F.col("own").isNull(), evidence).otherwise(F.array(*[F.lit(math.log(v)) for v in each]))
    priors = host_priors(decided, classes, weight)
    joined = scored.join(priors, "host", "left").withColumn("prior", F.coalesce("prior", F.array_repeat(F.lit(1.0 / classes), classes)))
    joined = joined.withColumn("prior", F.transform("prior", F.ln)).withColumn("evidence", evidence)
    joined = joined.withColumn("log", F.zip_with(F.zip_with("scores", "prior", lambda a, b: a + b), "evidence", lambda a, b: a + b))
    if rare:
        mine = F.col("own_score") + F.get("prior", F.lit(pool)) + math.log(share[pool][pool] * same)
        take = F.coalesce((F.col("rare") == F.col("own")) | (mine >= F.get("log", F.lit(pool))), F.lit(False))
        joined = joined.withColumn("log", F.when(take, F.transform("log", lambda x, i: F.when(i == pool, mine).otherwise(x))).otherwise(F.col("log")))
        joined = joined.withColumn("rare", F.when(take, F.col("own")).otherwise(F.col("rare")))
        joined = joined.join(names.withColumnRenamed("number", "rare"), "rare", "left")
    top = F.array_max("log")
    joined = joined.withColumn("best", _best("log")).withColumn("posterior", 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    names_of = F.array(*[F.lit(x) for x in known], *([F.col("rare_name")] if rare else []), F.lit(None).cast("string"))
    told, und = F.col("n_letters") > 0, F.col("best") == classes - 1
    unmodelled = F.col("declared").isNotNull() & (F.trim("declared") != "") & ~F.col("declared").isin(known) & F.col("own").isNull()
    given = F.when(und & unmodelled, F.col("declared")).otherwise(F.get(names_of, "best"))
    return joined.select(
        *[F.col(k).alias(c) for c, k in own.items()],
        F.when(told, given).alias(language),
        F.round("posterior", 6).alias(posterior),
        (told & F.coalesce(~und | unmodelled, F.lit(False))).alias(kept),
    )


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose language is told, with all their columns."""
    row, i = fresh(docs.columns, "row_in"), fresh(docs.columns, "id_in")
    keyed = docs.withColumn(row, F.xxhash64(F.col(text_col).cast("string")))
    found = identify(keyed, [id_col, row], text_col=text_col, **options)
    gone = store(found.filter(~F.col(found.columns[-1])).select(F.col(id_col).alias(i), F.col(row).alias(f"{row}_2")).distinct(), "language-rejected")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(row) == F.col(f"{row}_2"))
    return keyed.join(gone, same, "left_anti").drop(row)
