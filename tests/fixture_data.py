"""Hand-made reference-shaped tables with the edge cases of each analysis.

Expected values in the tests are worked out by hand from these rows.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

import duckdb

from ledgerlens.params import REFERENCE_PARAMS
from ledgerlens.schema import SCHEMAS
from ledgerlens.sources.tables import Tables

PARAMS = REFERENCE_PARAMS.with_(vendor_product_min_qty=50)


def m(x) -> D:
    return D(str(x)).quantize(D("0.0001"))


# SalesOrderID, SalesOrderNumber, CustomerID, SalesPersonID, TerritoryID,
# OrderDate, Status, SubTotal, OnlineOrderFlag
HEADER = [
    (1, "SO1", 1, 7, 1, datetime(2011, 5, 10), 5, m(300), 0),
    (2, "SO2", 1, None, 1, datetime(2011, 5, 20), 5, m(90), 1),
    (3, "SO3", 2, None, 2, datetime(2011, 6, 1), 5, m(80), 1),
    (4, "SO4", 3, None, 2, datetime(2011, 8, 15), 5, m(70), 1),
    (5, "SO5", 4, None, 2, datetime(2011, 9, 30, 23, 59), 5, m(60), 1),
    (6, "SO6", 5, None, 3, datetime(2011, 9, 1), 5, m(50), None),
    (7, "SO7", 6, None, 3, datetime(2012, 2, 1), 5, m(0), 1),
    (8, "SO8", 7, None, 3, datetime(2012, 4, 1), 5, m(50), 1),
    (9, "SO9", 8, 9, 2, datetime(2012, 5, 5), 5, m(290), 0),
    (10, "SO10", 9, 9, 4, datetime(2012, 6, 30), 1, m(999), 0),
    (11, "SO11", 10, 7, 1, datetime(2012, 6, 1), 5, m(110), 0),
    (12, "SO12", 3, None, 3, datetime(2012, 6, 2), 5, m(80), 1),
]

# SalesOrderID, ProductID, OrderQty, LineTotal
DETAIL = [
    (1, 1, 2, m(100)),
    (9, 2, 1, m(60)),
    (3, 3, 1, m(50)),
    (4, 4, 2, m(40)),
    (11, 5, 1, m(30)),
    (12, 6, 1, m(15)),
    (5, 7, 1, m(14)),
    (6, 8, 1, m(0)),
    (8, 9, 1, m(6)),
    (8, 10, 1, m(6)),
    (2, 11, 1, m(6)),
    (2, 12, 1, m(3)),
    (7, 13, 1, m(3)),
    (7, 15, 1, m(3)),
    (10, 16, 1, m(24)),
]

PRODUCT = [
    (1, "Mountain-200 Black, 38", m(10)),
    (2, "Mountain-200 Silver, 42", m(10)),
    (3, "Road-150 Red, 62", m(20)),
    (4, "Touring-1000 Blue, 46", m(30)),
    (5, "Road-650 Red, 44", m(40)),
    (6, "HL Road-650 Frame", m(5)),
    (7, "Sport-100 Helmet", m(1)),
    (8, "Freebie", m(2)),
    (9, "Cap A", m(1)),
    (10, "Cap B", m(1)),
    (11, "Cap C", m(1)),
    (12, "Cap D", m(1)),
    (13, "Cap E", m(1)),
    (14, "Never Sold", m(3)),
    (15, "Cap F", m(1)),
    (16, "Road-650 Black, 52", m(40)),
]

CUSTOMER = [
    (1, 101, 1),
    (2, None, 2),
    (3, None, 2),
    (4, None, 2),
    (5, None, 3),
    (6, None, 3),
    (7, None, 3),
    (8, 108, 2),
    (9, 109, 4),
    (10, 110, 1),
]
TERRITORY = [(1, "North"), (2, "South"), (3, "East"), (4, "West")]
PO_HEADER = [("PO1", 1, 4), ("PO2", 1, 4), ("PO3", 2, 4), ("PO4", 2, 1), ("PO5", 3, 4)]
PO_DETAIL = [
    ("PO1", 1, 100, 2),
    ("PO1", 2, 50, 0),
    ("PO2", 1, 20, 1),
    ("PO3", 3, 10, 1),
    ("PO4", 3, 1000, 500),
    ("PO5", 4, 10, 0),
]
VENDOR = [(1, "Alpha"), (2, "Beta"), (3, "Gamma"), (4, "Delta")]
WORK_ORDER = [(1, 10), (1, 5), (2, 7), (None, 100), (99, 50)]
SCRAP_REASON = [(1, "Paint process failed"), (2, "Trim length too long"), (3, "Drill size too small")]

ROWS = {
    "sales_order_header": HEADER,
    "sales_order_detail": DETAIL,
    "customer": CUSTOMER,
    "sales_territory": TERRITORY,
    "product": PRODUCT,
    "purchase_order_header": PO_HEADER,
    "purchase_order_detail": PO_DETAIL,
    "vendor": VENDOR,
    "work_order": WORK_ORDER,
    "scrap_reason": SCRAP_REASON,
}

# DuckDB names of the oracle's reference-shaped tables.
DUCK_NAMES = {
    "sales_order_header": "soh",
    "sales_order_detail": "sod",
    "customer": "cust",
    "sales_territory": "terr",
    "product": "prod",
    "purchase_order_header": "poh",
    "purchase_order_detail": "pod",
    "vendor": "vend",
    "work_order": "wo",
    "scrap_reason": "sr",
}


def tables(spark, rows=None) -> Tables:
    rows = rows or ROWS
    return Tables(**{n: spark.createDataFrame(rows[n], schema=SCHEMAS[n]) for n in ROWS})


def _duck_type(t) -> str:
    s = t.simpleString()
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp": "TIMESTAMP"}.get(
        s, s.upper()
    )


def duck(rows=None) -> duckdb.DuckDBPyConnection:
    rows = rows or ROWS
    con = duckdb.connect()
    for name, duck_name in DUCK_NAMES.items():
        cols = ", ".join(f"{f.name} {_duck_type(f.dataType)}" for f in SCHEMAS[name].fields)
        con.execute(f"CREATE TABLE {duck_name} ({cols})")
        marks = ", ".join("?" for _ in SCHEMAS[name].fields)
        if rows[name]:
            con.executemany(f"INSERT INTO {duck_name} VALUES ({marks})", [list(r) for r in rows[name]])
    return con
