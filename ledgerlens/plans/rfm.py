"""Recency-Frequency-Monetary customer segmentation.

The reference builds three customer aggregates, ranks each with a global
``PERCENT_RANK`` window and stitches them with two left joins. Here one
``groupBy(CustomerID)`` yields all three measures, and the scores come from
exact cut values (``operators.quantiles``): no window over all customers, no
join back. The scored table is the reference's session table: written once
as Parquet in the checkpoint folder, and read by every result of the same
bundle of tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.labels import rfm_code, segment_by_rules
from ledgerlens.functions.measures import money_sum, pct
from ledgerlens.operators.quantiles import percent_rank_tiers
from ledgerlens.params import SEGMENT_DEFAULT, Params
from ledgerlens.sources.sinks import materialize
from ledgerlens.sources.tables import Tables

def customer_measures(header: DataFrame, as_of: str) -> DataFrame:
    """Per customer: revenue, distinct orders, days from last order to ``as_of``."""
    return header.groupBy("CustomerID").agg(
        money_sum("SubTotal").alias("TotalRev"),
        F.count_distinct("SalesOrderNumber").alias("TotalOrder"),
        F.datediff(F.lit(as_of).cast(T.DateType()), F.max("OrderDate").cast(T.DateType()))
        .cast(T.IntegerType())
        .alias("GapDay"),
    )


def score(measures: DataFrame, p: Params) -> DataFrame:
    """Scores, RFM code and segment for a customer-measure table.

    A NULL CustomerID group takes part in all three rankings, but like the
    reference's left joins on it, it keeps only its Monetary score.
    """
    scored = percent_rank_tiers(
        measures,
        {
            "Monetary": ("TotalRev", False),
            "Frequency": ("TotalOrder", False),
            "Recency": ("GapDay", True),
        },
        p.tier_cuts,
        p.tier_ranges,
    )
    known = {c: f"CASE WHEN CustomerID IS NOT NULL THEN {c} END" for c in ("TotalOrder", "Frequency", "GapDay", "Recency")}
    known_scores = scored.selectExpr(
        "CustomerID",
        "TotalRev",
        "Monetary",
        f"{known['TotalOrder']} AS TotalOrder",
        f"{known['Frequency']} AS Frequency",
        f"{known['GapDay']} AS GapDay",
        f"{known['Recency']} AS Recency",
    )
    coded = known_scores.withColumn("RFM", rfm_code("Recency", "Frequency", "Monetary"))
    return coded.withColumn("Cus_Category", segment_by_rules("RFM", p.segment_rules, SEGMENT_DEFAULT))


def rfm(header: DataFrame, p: Params) -> DataFrame:
    """RFM table of the customers in ``header`` as of ``p.as_of``.

    The customer measures are stored first: the boundaries, the cuts and the
    scoring read them, and a lost executor does not send any of these back
    to the order header.
    """
    return score(materialize(customer_measures(header, p.as_of), "rfm_measures"), p)


def rfm_customers(t: Tables, p: Params) -> DataFrame:
    """The scored table of this bundle, built on first use and stored."""
    return t.shared(("rfm", p), lambda: materialize(rfm(t.sales_order_header, p), "rfm_customers"))


def segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers and revenue per segment, with shares of the totals.

    The totals are windows over the (at most a few) segment rows, so the
    customer table is read once.
    """
    per_seg = rfm.groupBy("Cus_Category").agg(
        F.count(F.lit(1)).alias("NumCustomer"), money_sum("TotalRev").alias("TotalRevenue")
    )
    everything = Window.partitionBy()
    return per_seg.select(
        "Cus_Category",
        "NumCustomer",
        pct("NumCustomer", F.sum("NumCustomer").over(everything), 5, 2).alias("PercentCustomer"),
        "TotalRevenue",
        pct("TotalRevenue", F.sum("TotalRevenue").over(everything), 5, 2).alias("PercentRevenue"),
    )


def rfm_segments(t: Tables, p: Params) -> DataFrame:
    return segment_summary(rfm_customers(t, p))
