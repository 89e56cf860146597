"""Ranking and top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_METHODS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def ranked(
    df: DataFrame,
    measure: str,
    out: str,
    method: str = "rank",
    by: Sequence[str] = (),
    ascending: bool = False,
) -> DataFrame:
    """Add the rank of ``measure`` (within ``by``) as an INT column.

    Without ``by`` the window is global: use only on bounded inputs.
    """
    order = F.col(measure).asc() if ascending else F.col(measure).desc()
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order)
    return df.withColumn(out, _METHODS[method]().over(w).cast(T.IntegerType()))


def top_n_per_group(
    df: DataFrame,
    n: int,
    measure: str,
    by: Sequence[str],
    out: str,
    method: str = "dense_rank",
) -> DataFrame:
    """Rows whose rank within ``by`` is at most ``n`` (ties may add rows).

    The rank filter sits directly on the rank window, so Spark plans a
    partial ``WindowGroupLimit`` before the shuffle: each task forwards only
    its own top-n per group, and a hot group never lands whole on one task.
    """
    return ranked(df, measure, out, method, by).filter(F.col(out) <= n)


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows by ``order`` (a distributed top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)
