"""Shares of totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.measures import pct


def share_of_total(
    df: DataFrame,
    measure: str,
    out: str,
    precision: int,
    scale: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """``measure`` as % of its total over ``by`` (grand total if empty).

    Window form: use it when ``df`` is already small (one row per channel,
    segment, territory), so the window partition is bounded.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return df.withColumn(out, pct(F.col(measure), F.sum(measure).over(w), precision, scale))


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach ``totals`` (one row, or one row per ``by`` key) to every row.

    The one row of a global aggregate is broadcast; totals per key are joined
    the way Spark chooses from their measured size.
    """
    return df.join(totals, list(by)) if by else df.crossJoin(F.broadcast(totals))
