"""Integrity checks: count the rows that break a rule (expected 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expect_no_rows(
    fact: DataFrame,
    fact_rule: Column,
    dim: DataFrame,
    dim_rule: Column,
    key: str,
    counted: str,
    alias: str,
) -> DataFrame:
    """One row: non-NULL ``counted`` values of ``fact`` rows that break
    ``fact_rule`` and whose ``key`` matches a ``dim`` row breaking ``dim_rule``.

    Same count as joining first and filtering after, but the fact rows are
    counted per key before the join: the join sees one row per key, and a
    hot key is collapsed map-side instead of landing on one task.
    """
    per_key = fact.filter(fact_rule).groupBy(key).agg(F.count(F.col(counted)).alias("__n"))
    matched = per_key.join(dim.filter(dim_rule).select(key), key)
    return matched.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias(alias))
