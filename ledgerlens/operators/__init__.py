"""Reusable DataFrame operators the analyses are composed of."""

from ledgerlens.operators.checks import expect_no_rows
from ledgerlens.operators.growth import period_growth, period_totals
from ledgerlens.operators.profitability import (
    costed_lines,
    period_profit,
    priced,
    product_profit,
    product_sales,
)
from ledgerlens.operators.quantiles import percent_rank_cuts, percent_rank_tiers, quartile_score
from ledgerlens.operators.ranking import ranked, top_n, top_n_per_group
from ledgerlens.operators.share import share_of_total, with_totals

__all__ = [
    "expect_no_rows",
    "percent_rank_cuts",
    "percent_rank_tiers",
    "period_growth",
    "costed_lines",
    "period_profit",
    "period_totals",
    "priced",
    "product_profit",
    "product_sales",
    "quartile_score",
    "ranked",
    "share_of_total",
    "top_n",
    "top_n_per_group",
    "with_totals",
]
