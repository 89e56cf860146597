"""Revenue, cost, profit per product and per period.

Cost is ``OrderQty * StandardCost`` with the product's *current* cost.
At product grain the cost is constant per product, so ``sum(qty * cost)``
equals ``cost * sum(qty)`` exactly (decimal arithmetic): lines are summed
per product *before* the product join, which then sees one row per product.
At period grain the cost is taken per line, lines get their order's date, and
the period aggregate reduces them to a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.measures import money_sum, order_quarter, order_year, sum_int
from ledgerlens.operators.growth import PERIOD_KEYS
from ledgerlens.schema import MONEY_SUM


def product_sales(detail: DataFrame) -> DataFrame:
    """Per ProductID: ``Revenue`` (sum LineTotal) and ``Quantity``."""
    return detail.groupBy("ProductID").agg(
        money_sum("LineTotal").alias("Revenue"), sum_int("OrderQty").alias("Quantity")
    )


def costed_lines(detail: DataFrame, product: DataFrame, product_cols: Sequence[str] = ()) -> DataFrame:
    """Order lines with their cost (``OrderQty * StandardCost``).

    Filters on ``product`` (e.g. a product group) reach the lines through the
    inner join before anything else touches them. Spark broadcasts the
    product side only when its measured size is under the broadcast
    threshold; otherwise both sides are shuffled on ProductID and AQE splits
    a hot product.
    """
    dims = product.select("ProductID", "StandardCost", *product_cols)
    return detail.join(dims, "ProductID").select(
        "SalesOrderID",
        *product_cols,
        "LineTotal",
        (F.col("OrderQty") * F.col("StandardCost")).alias("LineCost"),
    )


def period_profit(
    header: DataFrame,
    detail: DataFrame,
    product: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "OrderDate",
) -> DataFrame:
    """Revenue, cost and profit per year, quarter (and product ``keys``).

    Costed lines join the header for their order's date: one shuffle of the
    lines on SalesOrderID (none where either side is small enough to be
    broadcast, or where both are bucketed on it). The period aggregate then leaves
    a few rows per task before the last shuffle. (Summing lines per order
    first saves little of the join's shuffle and adds one where the product
    table is broadcast; figures in PLANS.md.)
    """
    lines = costed_lines(detail, product, keys).join(header.select("SalesOrderID", ts), "SalesOrderID")
    return lines.groupBy(
        order_year(ts).alias(PERIOD_KEYS[0]), order_quarter(ts).alias(PERIOD_KEYS[1]), *keys
    ).agg(
        money_sum("LineTotal").alias("TotalRevenue"),
        money_sum("LineCost").alias("TotalCost"),
    ).withColumn("Profit", (F.col("TotalRevenue") - F.col("TotalCost")).cast(MONEY_SUM))


def priced(sales: DataFrame, product: DataFrame, product_cols: Sequence[str] = ("Name",)) -> DataFrame:
    """Join product cost to product-grain sales: adds ``Cost`` and ``Profit``."""
    dims = product.select("ProductID", "StandardCost", *product_cols)
    return (
        sales.join(dims, "ProductID")
        .withColumn("Cost", (F.col("StandardCost") * F.col("Quantity")).cast(MONEY_SUM))
        .withColumn("Profit", (F.col("Revenue") - F.col("Cost")).cast(MONEY_SUM))
    )


def product_profit(detail: DataFrame, product: DataFrame) -> DataFrame:
    """Per product: ProductID, Name, StandardCost, Revenue, Quantity, Cost, Profit."""
    return priced(product_sales(detail), product)
