"""Registry of the analyses: name -> plan, and the order each result is shown in.

``QUERIES`` maps a result-set name to a function ``(Tables, Params) ->
DataFrame``. ``ORDER`` holds the reference's ``ORDER BY`` for results that
have one; it is applied only at the edge (``run``), after all the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.params import STANDIN_PARAMS, Params
from ledgerlens.plans import findings, product, purchasing, rfm, sales
from ledgerlens.sources.standin import standin_tables
from ledgerlens.sources.tables import Tables

Plan = Callable[[Tables, Params], DataFrame]

QUERIES: dict[str, Plan] = {
    "chk_offline_nonstore": sales.chk_offline_nonstore,
    "chk_online_store": sales.chk_online_store,
    "q1_quarterly_growth": sales.q1_quarterly_growth,
    "q2_territory_rank": sales.q2_territory_rank,
    "q3_channel_share": sales.q3_channel_share,
    "q4_top5_customers": sales.q4_top_customers,
    "q5_top10_profit": product.q5_top_profit,
    "q6a_vendor_reject": purchasing.q6a_vendor_reject,
    "q6b_vendor_product_reject": purchasing.q6b_vendor_product_reject,
    "q7_high_revenue_loss": product.q7_high_revenue_loss,
    "q8_line_margin_by_quarter": product.q8_line_margin_by_quarter,
    "scrap_reasons": purchasing.scrap_reasons,
    "kpi1_quarterly_margin": product.kpi1_quarterly_margin,
    "kpi2_aov_by_channel": sales.kpi2_aov_by_channel,
    "kpi3_loss_product_rate": product.kpi3_loss_product_rate,
    "rfm_customers": rfm.rfm_customers,
    "rfm_segments": rfm.rfm_segments,
    "d1_seasonal_dip": findings.d1_seasonal_dip,
    "d2_aov_ratio": findings.d2_aov_ratio,
    "d3_topn_concentration": findings.d3_topn_concentration,
    "d4_line_profit_range": findings.d4_line_profit_range,
    "d5_loss_products_all": product.d5_loss_products_all,
    "d6_reject_spread": findings.d6_reject_spread,
    "d6_worst_product": findings.d6_worst_product,
    "d7_margin_extremes": findings.d7_margin_extremes,
    "d8_first_positive": findings.d8_first_positive,
    "d9_segment_rollup": findings.d9_segment_rollup,
    "d10_growth_run": findings.d10_growth_run,
    "d11_low_margin_run": findings.d11_low_margin_run,
    "d12_group_margin_range": findings.d12_group_margin_range,
    "d13_line_profit_share": findings.d13_line_profit_share,
}


def _period() -> list[Column]:
    return [F.col("OrderYear").asc(), F.col("OrderQuarter").asc()]


# Built on demand: Column objects need a running session.
ORDER: dict[str, Callable[[], list[Column]]] = {
    "q1_quarterly_growth": lambda: _period(),
    "q2_territory_rank": lambda: [F.col("RevenueRank").asc(), F.col("TerritoryName").asc()],
    "q4_top5_customers": lambda: [F.col("CustomerType").asc(), F.col("SalesRank").asc(), F.col("CustomerID").asc()],
    "q5_top10_profit": lambda: [F.col("TotalProfit").desc(), F.col("ProductID").asc()],
    "q6a_vendor_reject": lambda: [purchasing.reject_ratio().desc_nulls_last(), F.col("VendorID").asc()],
    "q6b_vendor_product_reject": lambda: [purchasing.reject_ratio().desc_nulls_last(), F.col("VendorID").asc(), F.col("ProductID").asc()],
    "q7_high_revenue_loss": lambda: [F.col("Revenue").desc(), F.col("ProductID").asc()],
    "q8_line_margin_by_quarter": lambda: _period() + [F.col("ProductType").asc()],
    "scrap_reasons": lambda: [F.col("TotalScrappedQty").desc(), F.col("ScrapReasonID").asc()],
    "kpi1_quarterly_margin": lambda: _period(),
    "kpi2_aov_by_channel": lambda: [F.col("SalesChannel").asc()],
    "rfm_segments": lambda: [F.col("TotalRevenue").desc()],
    "d1_seasonal_dip": lambda: [F.col("OrderQuarter").asc()],
    "d5_loss_products_all": lambda: [F.col("Revenue").desc(), F.col("ProductID").asc()],
    "d6_worst_product": lambda: [purchasing.reject_ratio().desc_nulls_last(), F.col("VendorID").asc()],
    "d8_first_positive": lambda: [F.col("ProductType").asc()],
    "d9_segment_rollup": lambda: [F.col("SegmentSet").asc()],
    "d12_group_margin_range": lambda: [F.col("ProductType").asc()],
    "d13_line_profit_share": lambda: [F.col("TotalProfit").desc(), F.col("ProductLine").asc()],
}


def run(name: str, t: Tables, p: Params, ordered: bool = True) -> DataFrame:
    """Build result ``name``; sort it as the reference does if ``ordered``."""
    df = QUERIES[name](t, p)
    order = ORDER.get(name)
    if not (ordered and order):
        return df
    return df.orderBy(*order())


def standin_query(name: str, ordered: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """``(spark, sf_dir) -> DataFrame`` for result ``name`` on the stand-in views."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, standin_tables(spark, sf_dir), STANDIN_PARAMS, ordered)

    build.__name__ = name
    return build
