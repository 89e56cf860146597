"""Measures: exact money sums, guarded percentage rates, calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import MONEY_SUM

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: ColumnOrName) -> Column:
    """Exact sum of a money column, as ``DECIMAL(38,4)``."""
    return F.sum(_col(c)).cast(MONEY_SUM)


def sum_int(c: ColumnOrName) -> Column:
    """Sum of an integer quantity, as ``BIGINT``."""
    return F.sum(_col(c)).cast(T.LongType())


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` in double; NULL for a zero denominator (the ``NULLIF`` guard)."""
    return _col(num).cast(T.DoubleType()) / F.nullif(_col(den).cast(T.DoubleType()), F.lit(0.0))


def rate(
    num: ColumnOrName,
    den: ColumnOrName,
    precision: int,
    scale: int,
    per: float = 1.0,
    on_zero: str = "null",
) -> Column:
    """``num * per / den`` cast to ``DECIMAL(precision, scale)``.

    Both sides are exact sums; the ratio is taken in double (as the
    reference's ``*100.0`` promotion does) and rounded half-up by the cast.
    A zero denominator gives NULL (``on_zero='null'``, the ``NULLIF`` guard)
    or 0 (``on_zero='zero'``, the ``CASE WHEN x = 0 THEN 0`` guard).
    """
    kind = T.DecimalType(precision, scale)
    out = ratio(_col(num).cast(T.DoubleType()) * F.lit(per), den).cast(kind)
    if on_zero == "zero":
        return F.when(_col(den).cast(T.DoubleType()) == 0.0, F.lit(0).cast(kind)).otherwise(out)
    if on_zero != "null":
        raise ValueError(f"on_zero must be 'null' or 'zero', got {on_zero!r}")
    return out


def pct(num: ColumnOrName, den: ColumnOrName, precision: int, scale: int, on_zero: str = "null") -> Column:
    """``rate`` per hundred."""
    return rate(num, den, precision, scale, 100.0, on_zero)


def order_year(ts: ColumnOrName) -> Column:
    return F.year(_col(ts)).cast(T.IntegerType())


def order_quarter(ts: ColumnOrName) -> Column:
    return F.quarter(_col(ts)).cast(T.IntegerType())

