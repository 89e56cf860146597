"""Product analyses: top profit, loss makers, product-line margins, KPIs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.labels import label_by_prefix
from ledgerlens.functions.measures import pct
from ledgerlens.operators.growth import PERIOD_KEYS
from ledgerlens.operators.profitability import period_profit, product_profit
from ledgerlens.operators.ranking import top_n
from ledgerlens.operators.share import with_totals
from ledgerlens.sources.sinks import materialize
from ledgerlens.params import HIGH_PROFIT_LABEL, LOW_PROFIT_LABEL, OTHER_LABEL, Params
from ledgerlens.sources.tables import Tables


def stored_profit(t: Tables) -> DataFrame:
    """The per-product table, for results that read it more than once: lines are
    aggregated and joined to products once per bundle, then stored."""
    return t.shared("product_profit", lambda: materialize(product_profit(t.sales_order_detail, t.product), "product_profit"))


def profit_share(t: Tables) -> DataFrame:
    """Per product: TotalProfit and its % of all products' profit."""
    prof = stored_profit(t).select("ProductID", F.col("Name").alias("ProductName"), F.col("Profit").alias("TotalProfit"))
    total = prof.agg(F.sum("TotalProfit").alias("AllProfit"))
    return with_totals(prof, total).withColumn("ProfitRatePct", pct("TotalProfit", "AllProfit", 20, 4))


def q5_top_profit(t: Tables, p: Params) -> DataFrame:
    """Top products by profit (ties broken by lower ProductID), share of all."""
    shares = profit_share(t)
    return top_n(shares, p.top_products, [F.col("TotalProfit").desc(), F.col("ProductID").asc()]).select(
        "ProductID", "ProductName", "TotalProfit", "ProfitRatePct"
    )


def _margins(prof: DataFrame) -> DataFrame:
    return prof.select(
        "ProductID",
        F.col("Name").alias("ProductName"),
        "Revenue",
        "Profit",
        pct("Profit", "Revenue", 19, 6, on_zero="zero").alias("ProfitMarginPct"),
    )


def q7_high_revenue_loss(t: Tables, p: Params) -> DataFrame:
    """Loss-making products whose revenue is above the mean product revenue.

    ``Revenue > avg`` is tested as ``Revenue * n > sum`` — exact in decimal.
    The mean comes from a one-row aggregate of the same per-product table,
    which is stored: the mean needs only revenue, so Spark would otherwise
    aggregate the order lines a second time.
    """
    m = _margins(stored_profit(t))
    stats = m.agg(F.sum("Revenue").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    return (
        with_totals(m, stats)
        .filter((F.col("Revenue") * F.col("__n") > F.col("__sum")) & (F.col("Profit") < 0))
        .drop("__sum", "__n")
    )


def d5_loss_products_all(t: Tables, p: Params) -> DataFrame:
    """Q7 without the above-average filter: every loss-making product."""
    return _margins(product_profit(t.sales_order_detail, t.product)).filter(F.col("Profit") < 0)


def _quarterly(t: Tables, p: Params, with_type: bool) -> DataFrame:
    product = t.product
    keys: tuple[str, ...] = ()
    if with_type:
        groups = [(HIGH_PROFIT_LABEL, p.high_prefixes), (LOW_PROFIT_LABEL, p.low_prefixes)]
        # The type depends on the name only: products of neither group (and
        # their lines) are dropped before any join. Written as an OR of
        # prefix tests, the filter reaches the Parquet scan (StringStartsWith).
        in_a_group = reduce(or_, [F.col("Name").startswith(x) for _, xs in groups for x in xs])
        product = product.filter(in_a_group).withColumn("ProductType", label_by_prefix("Name", groups, OTHER_LABEL))
        keys = ("ProductType",)
    return period_profit(t.sales_order_header, t.sales_order_detail, product, keys)


def q8_line_margin_by_quarter(t: Tables, p: Params) -> DataFrame:
    """Quarterly revenue, cost, profit and margin of the two product groups."""
    q = _quarterly(t, p, with_type=True)
    return q.select(
        *PERIOD_KEYS,
        "ProductType",
        "TotalRevenue",
        "TotalCost",
        F.col("Profit").alias("TotalProfit"),
        pct("Profit", "TotalRevenue", 8, 2).alias("ProfitRate"),
    )


def kpi1_quarterly_margin(t: Tables, p: Params) -> DataFrame:
    """Revenue, cost, profit and margin per quarter."""
    q = _quarterly(t, p, with_type=False)
    return q.select(
        *PERIOD_KEYS,
        "TotalRevenue",
        "TotalCost",
        "Profit",
        pct("Profit", "TotalRevenue", 8, 2).alias("ProfitRate"),
    )


def kpi3_loss_product_rate(t: Tables, p: Params) -> DataFrame:
    """Loss-making products among products with sales."""
    prof = product_profit(t.sales_order_detail, t.product)
    return prof.agg(
        F.count(F.when(F.col("Profit") < 0, F.lit(1))).alias("LossProducts"),
        F.count(F.lit(1)).alias("TotalProducts"),
    ).withColumn("LossProductRate", pct("LossProducts", "TotalProducts", 8, 2))


__all__ = [
    "profit_share",
    "q5_top_profit",
    "q7_high_revenue_loss",
    "d5_loss_products_all",
    "q8_line_margin_by_quarter",
    "kpi1_quarterly_margin",
    "kpi3_loss_product_rate",
]
