"""Parameters of the analyses: every literal the reference hard-codes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

# Product-line name prefixes of the two profit groups, the
# group labels, and the RFM segment rules (pattern over the
# Recency-Frequency-Monetary code, first match wins, then the default).
HIGH_PROFIT_LABEL = "High-profit Product"
LOW_PROFIT_LABEL = "Low-profit Product"
OTHER_LABEL = "Other"
REFERENCE_HIGH_PREFIXES = ("Mountain-200", "Road-150")
REFERENCE_LOW_PREFIXES = ("Touring-1000", "Road-650")
SEGMENT_RULES = (
    ("Best Customer", "444"),
    ("Loyal High Value", "4%4"),
    ("Potential Loyal", "3%4"),
    ("Almost Big Customer", "2%4"),
    ("Lost Big Customer", "1%4"),
    ("At Risk", "1%"),
    ("Almost Lost", "2%"),
    ("Recent Customer", "4%"),
)
SEGMENT_DEFAULT = "Other"
# Product lines, by name prefix, whose profits the findings quote.
REFERENCE_LINES = ("Mountain-200", "Road-150", "Touring-1000", "Road-650")
# Named unions of segments whose shares the findings quote.
SEGMENT_SETS = (
    ("Potential Loyal + Best Customer", ("Potential Loyal", "Best Customer")),
    ("At Risk + Recent Customer + Almost Lost", ("At Risk", "Recent Customer", "Almost Lost")),
    ("At Risk + Almost Lost", ("At Risk", "Almost Lost")),
)


@dataclass(frozen=True)
class Params:
    # Status codes are compared as literals against the tables' own type
    # (an int code in the reference schema, a letter in the stand-in).
    completed_order_status: int | str = 5
    completed_po_status: int | str = 4
    top_customers: int = 5
    top_products: int = 10
    vendor_product_min_qty: int = 5000
    high_prefixes: tuple[str, ...] = REFERENCE_HIGH_PREFIXES
    low_prefixes: tuple[str, ...] = REFERENCE_LOW_PREFIXES
    product_lines: tuple[str, ...] = REFERENCE_LINES
    # The findings' low margin, in percent, and the quarters (first and last) that the
    # margin range of the product groups is quoted for.
    low_margin_pct: Decimal = Decimal("4")
    margin_from: tuple[int, int] = (2011, 2)
    margin_to: tuple[int, int] = (2012, 2)
    # Whether the order header carries its territory, or the customer does.
    territory_on: str = "header"
    # Customers are scored in this many value ranges per measure (None: the
    # session's shuffle partitions). It sets parallelism, not results.
    tier_ranges: int | None = None
    as_of: str = "2014-06-30"
    tier_cuts: tuple[float, float, float] = (0.25, 0.5, 0.75)
    segment_rules: tuple[tuple[str, str], ...] = field(default=SEGMENT_RULES)
    segment_sets: tuple[tuple[str, tuple[str, ...]], ...] = field(default=SEGMENT_SETS)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


REFERENCE_PARAMS = Params()

# The same analyses on the stand-in views over the TPC-H-like test tables.
STANDIN_PARAMS = Params(
    completed_order_status="F",
    completed_po_status="F",
    vendor_product_min_qty=40,
    high_prefixes=("blue", "hot"),
    low_prefixes=("cold", "old"),
    product_lines=("blue", "hot", "cold", "old"),
    low_margin_pct=Decimal("12"),
    margin_from=(1995, 2),
    margin_to=(1997, 4),
    territory_on="customer",
    as_of="2001-08-31",
)
