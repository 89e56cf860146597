"""Connected components of a link table, by alternating large-star and
small-star steps on Spark: each step is one grouped aggregation, no vertex
needs its whole neighbourhood in memory, and the number of steps grows with the
logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, store


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to u's smallest neighbour (or u)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return out.select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    ties = e.join(least, "b").filter(F.col("a") > F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return ties.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is its smallest node.

    Nulls and self-links are left out; an empty table gives none.
    """
    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    e = store(e, "links")
    seen = None
    while True:
        last, e = e, store(_small_star(_large_star(e)), "links")
        discard(last)
        # A star forest: no node is both a centre and a leaf, and each leaf has one centre.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
