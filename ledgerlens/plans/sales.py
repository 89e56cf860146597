"""Sales analyses: integrity checks, revenue trend, territories, channels,
top customers, average order value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.labels import channel_by_flag, channel_by_sales_person
from ledgerlens.functions.measures import money_sum, pct, rate
from ledgerlens.operators.checks import expect_no_rows
from ledgerlens.operators.growth import period_growth, period_totals
from ledgerlens.operators.ranking import ranked, top_n_per_group
from ledgerlens.operators.share import share_of_total, with_totals
from ledgerlens.params import Params
from ledgerlens.sources.tables import Tables


def chk_offline_nonstore(t: Tables, p: Params) -> DataFrame:
    """Orders with a sales person whose customer has no store (expected 0)."""
    return expect_no_rows(
        t.sales_order_header,
        F.col("SalesPersonID").isNotNull(),
        t.customer,
        F.col("StoreID").isNull(),
        "CustomerID",
        "SalesOrderID",
        "OrderCount",
    )


def chk_online_store(t: Tables, p: Params) -> DataFrame:
    """Orders without a sales person whose customer has a store (expected 0)."""
    return expect_no_rows(
        t.sales_order_header,
        F.col("SalesPersonID").isNull(),
        t.customer,
        F.col("StoreID").isNotNull(),
        "CustomerID",
        "SalesOrderID",
        "OrderCount",
    )


def q1_quarterly_growth(t: Tables, p: Params) -> DataFrame:
    totals = period_totals(t.sales_order_header, "OrderDate", "SubTotal", "TotalQuarterlyRevenue")
    return period_growth(
        totals,
        "TotalQuarterlyRevenue",
        previous="PreviousQuarterRevenue",
        change="RevenueChange",
        growth="RevenueGrowthPercent",
    )


def q2_territory_rank(t: Tables, p: Params) -> DataFrame:
    """Completed-order revenue per territory, ranked (RANK, gaps after ties).

    ``p.territory_on`` says where the territory is recorded. On the customer,
    revenue is summed per customer *before* that join, so the join sees one
    row per customer, not one per order.
    """
    h = t.sales_order_header.filter(F.col("Status") == F.lit(p.completed_order_status))
    if p.territory_on not in ("header", "customer"):
        raise ValueError(f"territory_on must be 'header' or 'customer', got {p.territory_on!r}")
    if p.territory_on == "header":
        by_territory = h.groupBy("TerritoryID").agg(money_sum("SubTotal").alias("Revenue"))
    else:
        per_customer = h.groupBy("CustomerID").agg(money_sum("SubTotal").alias("Revenue"))
        by_territory = (
            per_customer.join(t.customer.select("CustomerID", "TerritoryID"), "CustomerID")
            .groupBy("TerritoryID")
            .agg(money_sum("Revenue").alias("Revenue"))
        )
    per_name = (
        by_territory.join(t.sales_territory.select("TerritoryID", F.col("Name").alias("TerritoryName")), "TerritoryID")
        .groupBy("TerritoryName")
        .agg(money_sum("Revenue").alias("TotalTerritoryRevenue"))
    )
    # One row per territory name: the global rank window is bounded.
    return ranked(per_name, "TotalTerritoryRevenue", "RevenueRank", method="rank")


def q3_channel_share(t: Tables, p: Params) -> DataFrame:
    """Revenue and orders per channel (sales person present = Offline), with shares."""
    per_channel = t.sales_order_header.groupBy(channel_by_sales_person().alias("Category")).agg(
        money_sum("SubTotal").alias("SalesTotal"), F.count("SalesOrderID").alias("OrderCount")
    )
    # Two rows: the share windows are bounded.
    out = share_of_total(per_channel, "SalesTotal", "SalesRate", 10, 4)
    return share_of_total(out, "OrderCount", "OrderRate", 10, 4)


def q4_top_customers(t: Tables, p: Params) -> DataFrame:
    """Top customers (DENSE_RANK <= n) per customer type with their share.

    A customer with both kinds of order appears under both types. The type
    totals are a two-row aggregate of the per-customer sums (same exchange,
    reused; broadcast), so the rank filter stays alone on its window and
    Spark limits each group per task before the shuffle.
    """
    ctype = channel_by_sales_person(with_person="Store", without="Person").alias("CustomerType")
    h = t.sales_order_header.select(ctype, "CustomerID", "SubTotal")
    per_customer = h.groupBy("CustomerType", "CustomerID").agg(money_sum("SubTotal").alias("TotalSales"))
    top = top_n_per_group(per_customer, p.top_customers, "TotalSales", ["CustomerType"], "SalesRank")
    type_totals = per_customer.groupBy("CustomerType").agg(money_sum("TotalSales").alias("TypeTotal"))
    return (
        with_totals(top, type_totals, ["CustomerType"])
        .withColumn("SalesRatePct", pct("TotalSales", "TypeTotal", 10, 4))
        .select("CustomerType", "CustomerID", "TotalSales", "SalesRank", "SalesRatePct")
    )


def kpi2_aov_by_channel(t: Tables, p: Params) -> DataFrame:
    """Orders, revenue and average order value per online flag.

    Grouped by the flag itself and labelled after, so a NULL flag is its own
    (second) 'Offline' row, as in the reference.
    """
    per_flag = t.sales_order_header.groupBy("OnlineOrderFlag").agg(
        F.count_distinct("SalesOrderID").alias("TotalOrders"), money_sum("SubTotal").alias("TotalRevenue")
    )
    aov = rate("TotalRevenue", "TotalOrders", 10, 2)
    return per_flag.select(
        channel_by_flag().alias("SalesChannel"), "TotalOrders", "TotalRevenue", aov.alias("AOV")
    )
