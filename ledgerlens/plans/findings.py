"""Roll-ups behind findings the reference states in prose only.

Each one reads the result of an analysis (already aggregated to a bounded
grain: quarters, channels, segments, the top products, vendors) and
reduces it further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.labels import label_by_prefix
from ledgerlens.functions.measures import money_sum, pct, ratio
from ledgerlens.operators.growth import PERIOD_KEYS
from ledgerlens.operators.profitability import product_profit
from ledgerlens.operators.ranking import top_n
from ledgerlens.operators.share import with_totals
from ledgerlens.params import OTHER_LABEL, Params
from ledgerlens.schema import MONEY_SUM
from ledgerlens.plans import product, purchasing, rfm, sales
from ledgerlens.sources.tables import Tables

def d1_seasonal_dip(t: Tables, p: Params) -> DataFrame:
    """Per quarter of the year: years compared, years with negative growth (of the exact change)."""
    g = sales.q1_quarterly_growth(t, p)
    return g.groupBy("OrderQuarter").agg(
        F.count("RevenueGrowthPercent").alias("YearsCompared"),
        F.count(F.when(F.col("RevenueGrowthPercent").isNotNull() & (F.col("RevenueChange") < 0), F.lit(1))).alias(
            "YearsDeclined"
        ),
    )


def d2_aov_ratio(t: Tables, p: Params) -> DataFrame:
    """Offline and online average order value and their ratio."""
    k = sales.kpi2_aov_by_channel(t, p).groupBy("SalesChannel").agg(
        F.sum("TotalOrders").alias("o"), F.sum("TotalRevenue").alias("r")
    )
    per = k.select("SalesChannel", ratio("r", "o").alias("aov"))
    off = F.max(F.when(F.col("SalesChannel") == "Offline", F.col("aov")))
    on = F.max(F.when(F.col("SalesChannel") == "Online", F.col("aov")))
    return per.agg(
        off.cast(T.DecimalType(10, 2)).alias("OfflineAOV"),
        on.cast(T.DecimalType(10, 2)).alias("OnlineAOV"),
        ratio(off, on).cast(T.DecimalType(10, 4)).alias("AOVRatio"),
    )


def d3_topn_concentration(t: Tables, p: Params) -> DataFrame:
    """Share of all profit earned by the top products."""
    shares = product.profit_share(t)
    top = top_n(shares, p.top_products, [F.col("TotalProfit").desc(), F.col("ProductID").asc()])
    return top.agg(
        F.count(F.lit(1)).alias("TopProducts"),
        money_sum("TotalProfit").alias("TopProfit"),
        F.max("AllProfit").cast(MONEY_SUM).alias("AllProfit"),
    ).withColumn("TopProfitSharePct", pct("TopProfit", "AllProfit", 20, 4))


def _line(name: str, p: Params) -> Column:
    return label_by_prefix(name, [(x, [x]) for x in p.product_lines], OTHER_LABEL)


def d4_line_profit_range(t: Tables, p: Params) -> DataFrame:
    """Among the top products: SKUs and profit range per declared product line (by name prefix)."""
    prof = product_profit(t.sales_order_detail, t.product).select(
        "ProductID", F.col("Name").alias("ProductName"), F.col("Profit").alias("TotalProfit")
    )
    top = top_n(prof, p.top_products, [F.col("TotalProfit").desc(), F.col("ProductID").asc()])
    return top.groupBy(_line("ProductName", p).alias("ProductLine")).agg(
        F.count(F.lit(1)).alias("SKUs"),
        F.min("TotalProfit").alias("MinProfit"),
        F.max("TotalProfit").alias("MaxProfit"),
    )


def d6_reject_spread(t: Tables, p: Params) -> DataFrame:
    """Spread of vendor reject rates: vendors, lowest and highest rate."""
    v = purchasing.q6a_vendor_reject(t, p)
    return v.agg(
        F.count(F.lit(1)).alias("Vendors"),
        F.min("RejectedRate").alias("MinRejectedRate"),
        F.max("RejectedRate").alias("MaxRejectedRate"),
    )


def d6_worst_product(t: Tables, p: Params) -> DataFrame:
    """Per vendor, the product (above the volume threshold) with the highest
    reject ratio; ties go to the lower ProductID."""
    v = purchasing.q6b_vendor_product_reject(t, p)
    w = Window.partitionBy("VendorID").orderBy(purchasing.reject_ratio().desc_nulls_last(), F.col("ProductID").asc())
    return v.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def d7_margin_extremes(t: Tables, p: Params) -> DataFrame:
    """Quarters of the lowest and the highest margin (earliest on ties; quarters without revenue have none)."""
    k = product.kpi1_quarterly_margin(t, p).withColumn("__m", ratio("Profit", "TotalRevenue")).filter("__m IS NOT NULL")
    keys = [F.col(c).asc() for c in PERIOD_KEYS]
    lo = k.withColumn("__r", F.row_number().over(Window.orderBy(F.col("__m").asc(), *keys)))
    hi = k.withColumn("__r", F.row_number().over(Window.orderBy(F.col("__m").desc(), *keys)))
    pick = ["OrderYear", "OrderQuarter", "ProfitRate"]
    return lo.filter("__r = 1").select(F.lit("Lowest").alias("Extreme"), *pick).unionByName(
        hi.filter("__r = 1").select(F.lit("Highest").alias("Extreme"), *pick)
    )


def d8_first_positive(t: Tables, p: Params) -> DataFrame:
    """First quarter in which each product group's profit is positive."""
    q = product.q8_line_margin_by_quarter(t, p).filter(F.col("TotalProfit") > 0)
    w = Window.partitionBy("ProductType").orderBy(*PERIOD_KEYS)
    return (
        q.withColumn("__r", F.row_number().over(w))
        .filter("__r = 1")
        .select("ProductType", "OrderYear", "OrderQuarter", "ProfitRate")
    )


def d9_segment_rollup(t: Tables, p: Params) -> DataFrame:
    """Customer and revenue shares of named unions of RFM segments."""
    seg = rfm.rfm_segments(t, p)
    member_of = F.array_compact(
        F.array(*[F.when(F.col("Cus_Category").isin(*members), F.lit(name)) for name, members in p.segment_sets])
    )
    everything = Window.partitionBy()
    seg = seg.select(
        "Cus_Category",
        "NumCustomer",
        "TotalRevenue",
        F.sum("NumCustomer").over(everything).alias("__c"),
        F.sum("TotalRevenue").over(everything).alias("__r"),
    )
    return (
        seg.select(F.explode(member_of).alias("SegmentSet"), "NumCustomer", "TotalRevenue", "__c", "__r")
        .groupBy("SegmentSet")
        .agg(
            F.sum("NumCustomer").alias("NumCustomer"),
            money_sum("TotalRevenue").alias("TotalRevenue"),
            F.max("__c").alias("__c"),
            F.max("__r").alias("__r"),
        )
        .select(
            "SegmentSet",
            "NumCustomer",
            pct("NumCustomer", "__c", 5, 2).alias("PercentCustomer"),
            "TotalRevenue",
            pct("TotalRevenue", "__r", 5, 2).alias("PercentRevenue"),
        )
    )


def longest_run(quarters: DataFrame) -> DataFrame:
    """The longest run of calendar quarters that follow one another (earliest on ties): its length,
    and all columns of its first (``First...``) and last (``Last...``) row.

    ``quarters`` has one row per quarter, so the windows are bounded; a missing quarter ends a run.
    """
    number = F.col("OrderYear") * 4 + F.col("OrderQuarter")
    island = number - F.row_number().over(Window.orderBy(number))
    cells = F.struct(number.alias("at"), *quarters.columns)
    runs = quarters.select(island.alias("island"), cells.alias("cell")).groupBy("island").agg(
        F.count(F.lit(1)).alias("RunQuarters"), F.min("cell").alias("first"), F.max("cell").alias("last")
    )
    longest = runs.orderBy(F.col("RunQuarters").desc(), F.col("first.at").asc()).limit(1)
    ends = [F.col(f"{end.lower()}.{c}").alias(f"{end}{c}") for end in ("First", "Last") for c in quarters.columns]
    return longest.select("RunQuarters", *ends)


def d10_growth_run(t: Tables, p: Params) -> DataFrame:
    """Longest run of quarters with growing revenue: quarters, first and last one."""
    grown = sales.q1_quarterly_growth(t, p).filter(F.col("RevenueChange") > 0)
    return longest_run(grown.select(*PERIOD_KEYS))


def d11_low_margin_run(t: Tables, p: Params) -> DataFrame:
    """Longest run of quarters with a margin under ``p.low_margin_pct``, and whether revenue grew over it."""
    k = product.kpi1_quarterly_margin(t, p)
    low = k.filter((F.col("TotalRevenue") != 0) & (F.col("Profit") * 100 < F.col("TotalRevenue") * F.lit(p.low_margin_pct)))
    run = longest_run(low.select(*PERIOD_KEYS, "TotalRevenue"))
    return run.withColumn("RevenueGrew", F.col("LastTotalRevenue") > F.col("FirstTotalRevenue"))


def d12_group_margin_range(t: Tables, p: Params) -> DataFrame:
    """Per product group, lowest and highest margin from ``p.margin_from`` to ``p.margin_to``."""
    number = F.col("OrderYear") * 4 + F.col("OrderQuarter")
    first, last = (y * 4 + q for y, q in (p.margin_from, p.margin_to))
    q8 = product.q8_line_margin_by_quarter(t, p).filter(number.between(first, last))
    return q8.groupBy("ProductType").agg(
        F.count(F.lit(1)).alias("Quarters"),
        F.min("ProfitRate").alias("MinProfitRate"),
        F.max("ProfitRate").alias("MaxProfitRate"),
    )


def d13_line_profit_share(t: Tables, p: Params) -> DataFrame:
    """Profit of each declared product line (by name prefix; the rest are one line) and its share of all profit."""
    per_line = product.stored_profit(t).groupBy(_line("Name", p).alias("ProductLine")).agg(
        F.count(F.lit(1)).alias("Products"), money_sum("Profit").alias("TotalProfit")
    )
    total = per_line.agg(F.sum("TotalProfit").alias("__all"))
    return with_totals(per_line, total).select(
        "ProductLine", "Products", "TotalProfit", pct("TotalProfit", "__all", 20, 4).alias("ProfitSharePct")
    )
