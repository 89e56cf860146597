"""Purchasing and production: vendor reject rates, scrap reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.measures import pct, ratio, sum_int
from ledgerlens.params import Params
from ledgerlens.sources.tables import Tables


def _completed_lines(t: Tables, p: Params, keys: tuple[str, ...]) -> DataFrame:
    """Ordered and rejected quantity of completed POs per vendor (+ keys).

    The status filter is pushed to the header scan; the header-detail join
    is the one fact-to-fact shuffle, and map-side partial aggregation by
    vendor then leaves at most vendors x keys rows per task.

    An order's id may have a second column, ``PurchaseOrderPart``, in both
    tables; they then join on both.
    """
    header, detail = t.purchase_order_header, t.purchase_order_detail
    order = [c for c in ("PurchaseOrderID", "PurchaseOrderPart") if c in header.columns and c in detail.columns]
    completed = header.filter(F.col("Status") == F.lit(p.completed_po_status)).select(*order, "VendorID")
    lines = detail.select(*order, *keys, "OrderQty", "RejectedQty")
    return (
        lines.join(completed, order)
        .groupBy("VendorID", *keys)
        .agg(sum_int("OrderQty").alias("TotalOrder"), sum_int("RejectedQty").alias("TotalReject"))
    )


def _with_vendor(per_vendor: DataFrame, t: Tables, keys: tuple[str, ...]) -> DataFrame:
    vendor = t.vendor.select(F.col("BusinessEntityID").alias("VendorID"), "Name")
    return per_vendor.join(vendor, "VendorID").select(
        "VendorID",
        "Name",
        *keys,
        "TotalOrder",
        "TotalReject",
        pct("TotalReject", "TotalOrder", 5, 2).alias("RejectedRate"),
    )


def q6a_vendor_reject(t: Tables, p: Params) -> DataFrame:
    """Ordered and rejected quantity and reject % per vendor (completed POs)."""
    return _with_vendor(_completed_lines(t, p, ()), t, ())


def q6b_vendor_product_reject(t: Tables, p: Params) -> DataFrame:
    """Same per vendor and product, for groups ordering more than the threshold."""
    per = _completed_lines(t, p, ("ProductID",)).filter(F.col("TotalOrder") > p.vendor_product_min_qty)
    return _with_vendor(per, t, ("ProductID",))


def reject_ratio() -> Column:
    """Unrounded reject ratio (the reference orders by it, highest first); NULL if nothing was ordered."""
    return ratio("TotalReject", "TotalOrder")


def scrap_reasons(t: Tables, p: Params) -> DataFrame:
    """Scrapped quantity per known reason; unknown or missing reasons drop out."""
    per_reason = (
        t.work_order.filter(F.col("ScrapReasonID").isNotNull())
        .groupBy("ScrapReasonID")
        .agg(sum_int("ScrappedQty").alias("TotalScrappedQty"))
    )
    return per_reason.join(t.scrap_reason.select("ScrapReasonID", "Name"), "ScrapReasonID").select(
        "TotalScrappedQty", "ScrapReasonID", "Name"
    )
