"""Period totals and period-over-period growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.measures import money_sum, order_quarter, order_year, pct
from ledgerlens.schema import MONEY_SUM

PERIOD_KEYS = ("OrderYear", "OrderQuarter")


def period_totals(df: DataFrame, ts: str, measure: str, total: str) -> DataFrame:
    """Exact sum of ``measure`` per calendar year and quarter of ``ts``."""
    return df.groupBy(order_year(ts).alias(PERIOD_KEYS[0]), order_quarter(ts).alias(PERIOD_KEYS[1])).agg(
        money_sum(measure).alias(total)
    )


def period_growth(
    totals: DataFrame,
    value: str,
    previous: str,
    change: str,
    growth: str,
    keys: tuple[str, ...] = PERIOD_KEYS,
    precision: int = 19,
    scale: int = 4,
) -> DataFrame:
    """Previous row's value, the change, and growth % (NULL when previous is 0).

    LAG takes the previous *row*: a period without data is not filled in.
    The window has no partition; its input is one row per period, so it is
    bounded by the calendar, not by the data volume.
    """
    w = Window.orderBy(*keys)
    prev: Column = F.lag(F.col(value)).over(w)
    return (
        totals.select(*keys, value, prev.alias(previous))
        .withColumn(change, (F.col(value) - F.col(previous)).cast(MONEY_SUM))
        .withColumn(growth, pct(change, previous, precision, scale))
    )
