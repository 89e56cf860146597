"""Declared schemas and column types of the reference-shaped model.

Money is exact: each row amount is ``DECIMAL(15,4)`` and every sum is
widened to ``DECIMAL(38,4)``, so totals never depend on partition order
(a ``DOUBLE`` sum would).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 4)
MONEY_SUM = T.DecimalType(38, 4)
UNIT_COST = T.DecimalType(12, 4)

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Only the columns the analyses read.
SCHEMAS: dict[str, T.StructType] = {
    "sales_order_header": _struct(
        ("SalesOrderID", _L, False),
        ("SalesOrderNumber", _S, False),
        ("CustomerID", _L, True),
        ("SalesPersonID", _L, True),
        ("TerritoryID", _I, True),
        ("OrderDate", T.TimestampType(), False),
        ("Status", _I, False),
        ("SubTotal", MONEY, False),
        ("OnlineOrderFlag", _I, True),
    ),
    "sales_order_detail": _struct(
        ("SalesOrderID", _L, False),
        ("ProductID", _L, False),
        ("OrderQty", _I, False),
        ("LineTotal", MONEY, False),
    ),
    "customer": _struct(
        ("CustomerID", _L, False),
        ("StoreID", _L, True),
        ("TerritoryID", _I, True),
    ),
    "sales_territory": _struct(("TerritoryID", _I, False), ("Name", _S, False)),
    "product": _struct(
        ("ProductID", _L, False), ("Name", _S, False), ("StandardCost", UNIT_COST, False)
    ),
    "purchase_order_header": _struct(
        ("PurchaseOrderID", _S, False), ("VendorID", _L, False), ("Status", _I, False)
    ),
    "purchase_order_detail": _struct(
        ("PurchaseOrderID", _S, False),
        ("ProductID", _L, False),
        ("OrderQty", _I, False),
        ("RejectedQty", _I, False),
    ),
    "vendor": _struct(("BusinessEntityID", _L, False), ("Name", _S, False)),
    "work_order": _struct(("ScrapReasonID", _I, True), ("ScrappedQty", _I, False)),
    "scrap_reason": _struct(("ScrapReasonID", _I, False), ("Name", _S, False)),
}
