"""Reference-shaped views over the TPC-H-like test tables.

Each view is a projection of the driver tables (``orders``, ``lineitem``,
``customer``, ``part``, ``supplier``, ``nation``, ``region``); the same
definitions are written as SQL in ``ledgerlens.plans.oracle`` so DuckDB can
check every result. Money is cast to decimal per row before any arithmetic.

The header carries no ``TerritoryID``: in the stand-in it is the
customer's nation, so it lives on ``customer`` and only the territory
analysis pays for the order-to-customer join.

A purchase order is an (order, supplier) pair: ``PurchaseOrderID`` and
``PurchaseOrderPart``. The id is never part of a result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import MONEY, UNIT_COST
from ledgerlens.sources.tables import Tables

# Fixed values of the stand-in mapping: order priorities handled by a sales
# person, the number of sales persons, order keys (modulo) placed offline, market
# segments that are stores, return flag of rejected / scrapped lines, cost markup.
SALES_PERSON_PRIORITIES = ("1-URGENT", "2-HIGH")
SALES_PERSONS = 17
OFFLINE_EVERY = 5
STORE_SEGMENTS = ("BUILDING", "MACHINERY")
REJECT_FLAG = "R"
COST_MARKUP = Decimal("1.85")


def standin_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Stand-in views over ``{sf_dir}/{table}.parquet``.

    Nothing is read until a query runs, and every bundle lists its files anew.
    """
    root = sf_dir.rstrip("/")
    raw: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in raw:
            raw[name] = spark.read.parquet(f"{root}/{name}.parquet")
        return raw[name]

    qty = F.col("l_quantity").cast(T.IntegerType())
    po_id = (F.col("l_orderkey").alias("PurchaseOrderID"), F.col("l_suppkey").alias("PurchaseOrderPart"))

    def header() -> DataFrame:
        by_sales_person = F.col("o_orderpriority").isin(*SALES_PERSON_PRIORITIES)
        return read("orders").select(
            F.col("o_orderkey").alias("SalesOrderID"),
            F.concat(F.lit("SO"), F.col("o_orderkey").cast(T.StringType())).alias("SalesOrderNumber"),
            F.col("o_custkey").alias("CustomerID"),
            F.when(by_sales_person, F.col("o_orderkey") % SALES_PERSONS).alias("SalesPersonID"),
            F.when(F.col("o_orderkey") % OFFLINE_EVERY == 0, F.lit(0)).otherwise(F.lit(1)).alias("OnlineOrderFlag"),
            F.col("o_orderdate").alias("OrderDate"),
            F.col("o_orderstatus").alias("Status"),
            F.col("o_totalprice").cast(MONEY).alias("SubTotal"),
        )

    def detail() -> DataFrame:
        line_total = (
            F.col("l_extendedprice").cast(T.DecimalType(12, 2))
            * (F.lit(Decimal("1.00")) - F.col("l_discount").cast(T.DecimalType(3, 2)))
        ).cast(MONEY)
        return read("lineitem").select(
            F.col("l_orderkey").alias("SalesOrderID"),
            F.col("l_partkey").alias("ProductID"),
            qty.alias("OrderQty"),
            line_total.alias("LineTotal"),
        )

    def customer() -> DataFrame:
        return read("customer").select(
            F.col("c_custkey").alias("CustomerID"),
            F.when(F.col("c_mktsegment").isin(*STORE_SEGMENTS), F.col("c_custkey")).alias("StoreID"),
            F.col("c_nationkey").alias("TerritoryID"),
        )

    def territory() -> DataFrame:
        return read("nation").select(F.col("n_nationkey").alias("TerritoryID"), F.col("n_name").alias("Name"))

    def product() -> DataFrame:
        return read("part").select(
            F.col("p_partkey").alias("ProductID"),
            F.col("p_name").alias("Name"),
            (F.col("p_retailprice").cast(T.DecimalType(8, 2)) * F.lit(COST_MARKUP))
            .cast(UNIT_COST)
            .alias("StandardCost"),
        )

    def po_header() -> DataFrame:
        # Distinct (order, supplier) pairs with the order's status. Joining
        # before the distinct gives the same rows (an order has one status)
        # and lets a status filter reach the orders scan and shrink the
        # distinct.
        orders = read("orders").select("o_orderkey", "o_orderstatus")
        return (
            read("lineitem")
            .select("l_orderkey", "l_suppkey")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("l_orderkey", "l_suppkey", "o_orderstatus")
            .distinct()  # on the raw keys: the join's partitioning on l_orderkey serves it
            .select(*po_id, F.col("l_suppkey").alias("VendorID"), F.col("o_orderstatus").alias("Status"))
        )

    def po_detail() -> DataFrame:
        return read("lineitem").select(
            *po_id,
            F.col("l_partkey").alias("ProductID"),
            qty.alias("OrderQty"),
            F.when(F.col("l_returnflag") == REJECT_FLAG, qty).otherwise(F.lit(0)).alias("RejectedQty"),
        )

    def vendor() -> DataFrame:
        return read("supplier").select(F.col("s_suppkey").alias("BusinessEntityID"), F.col("s_name").alias("Name"))

    def work_order() -> DataFrame:
        return read("lineitem").select(
            F.when(F.col("l_returnflag") == REJECT_FLAG, F.col("l_linenumber") - 1).alias("ScrapReasonID"),
            qty.alias("ScrappedQty"),
        )

    def scrap_reason() -> DataFrame:
        return read("region").select(F.col("r_regionkey").alias("ScrapReasonID"), F.col("r_name").alias("Name"))

    return Tables(
        sales_order_header=header,
        sales_order_detail=detail,
        customer=customer,
        sales_territory=territory,
        product=product,
        purchase_order_header=po_header,
        purchase_order_detail=po_detail,
        vendor=vendor,
        work_order=work_order,
        scrap_reason=scrap_reason,
    )
