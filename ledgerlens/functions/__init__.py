"""Column-level building blocks (all built-in, JVM-side expressions)."""

from ledgerlens.functions.labels import (
    channel_by_flag,
    channel_by_sales_person,
    label_by_prefix,
    rfm_code,
    segment_by_rules,
)
from ledgerlens.functions.measures import (
    money_sum,
    order_quarter,
    order_year,
    pct,
    rate,
    ratio,
    sum_int,
)

__all__ = [
    "channel_by_flag",
    "channel_by_sales_person",
    "label_by_prefix",
    "money_sum",
    "order_quarter",
    "order_year",
    "pct",
    "rate",
    "ratio",
    "rfm_code",
    "segment_by_rules",
    "sum_int",
]
