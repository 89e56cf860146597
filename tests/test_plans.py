"""Plan shape: the scalable forms Spark is expected to pick."""

from __future__ import annotations

import re
from datetime import datetime

import pytest

import __spark_entry__ as contract
from ledgerlens.operators import product_profit
from ledgerlens.params import STANDIN_PARAMS
from ledgerlens.plans import oracle, rfm
from ledgerlens.plans.catalog import QUERIES, run
from ledgerlens.sources.standin import standin_tables

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return standin_tables(spark, SF)


def test_top_customers_limits_groups_before_shuffle(t):
    p = plan(run("q4_top5_customers", t, STANDIN_PARAMS, ordered=False))
    assert "WindowGroupLimit" in p


def test_top_products_is_a_top_k(t):
    p = plan(run("q5_top10_profit", t, STANDIN_PARAMS))
    assert "TakeOrderedAndProject" in p


def test_status_filter_and_prefixes_reach_the_scan(t):
    p = plan(run("q2_territory_rank", t, STANDIN_PARAMS))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", p)
    for name in _TWO_LINE_SOURCES:
        final = plan(run(name, t, STANDIN_PARAMS))
        assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", final), name
    p8 = plan(run("q8_line_margin_by_quarter", t, STANDIN_PARAMS))
    assert re.search(r"PushedFilters: \[[^\]]*StringStartsWith\(p_name,", p8)


def test_column_pruning(t):
    p = plan(run("q1_quarterly_growth", t, STANDIN_PARAMS))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert len(schemas) == 1
    assert sorted(f.split(":")[0] for f in schemas[0].split(",")) == ["o_orderdate", "o_totalprice"]


def test_rfm_has_no_global_window_over_customers(t):
    p = plan(rfm.score(rfm.customer_measures(t.sales_order_header, STANDIN_PARAMS.as_of), STANDIN_PARAMS))
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # Only the partial results of global (keyless) aggregates move
            # to one partition.
            assert "HashAggregate(keys=[]" in lines[i + 1], line
    # Window partitions are (measure, range) or (measure): never empty.
    for w in re.findall(r"Window \[.*?\], \[(.*?)\], \[", p):
        assert w.strip(), "window without partition"


def test_entry_smoke(spark):
    df = contract.entry(spark)
    assert df.columns == ["Cus_Category", "NumCustomer", "PercentCustomer", "TotalRevenue", "PercentRevenue"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle.oracle_sql())
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


# The stand-in purchase-order header and lines are both views of lineitem.
_TWO_LINE_SOURCES = {"q6a_vendor_reject", "q6b_vendor_product_reject", "d6_reject_spread", "d6_worst_product"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_order_lines_read_once(t, name):
    """No analysis aggregates the order lines twice (no pruned twin branch)."""
    df = run(name, t, STANDIN_PARAMS)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    scans = len(re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", final))
    assert scans <= (2 if name in _TWO_LINE_SOURCES else 1), scans


def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    return old


def restore(spark, old):
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["kpi1_quarterly_margin", "q8_line_margin_by_quarter", "d7_margin_extremes", "d8_first_positive"])
def test_lines_are_dealt_by_order_once(spark, t, name):
    old = no_broadcast(spark)
    try:
        p = plan(run(name, t, STANDIN_PARAMS)).split("Initial Plan")[0]
    finally:
        restore(spark, old)
    # One exchange of the lines and one of the header on the join key; none for a per-order aggregate.
    assert len(re.findall(r"Exchange hashpartitioning\(SalesOrderID#\d+L", p)) == (2 if name != "d7_margin_extremes" else 4)


@pytest.mark.parametrize("name", ["q5_top10_profit", "d3_topn_concentration"])
def test_one_product_join(spark, name):
    old = no_broadcast(spark)
    try:
        fresh = standin_tables(spark, SF)
        joins = plan(product_profit(fresh.sales_order_detail, fresh.product)).count("SortMergeJoin")
        p = plan(run(name, fresh, STANDIN_PARAMS))
    finally:
        restore(spark, old)
    assert joins == 1
    assert "part.parquet" not in p and "SortMergeJoin" not in p  # it reads the stored per-product table


def test_rfm_results_share_one_pass_over_the_header(spark):
    reads = []

    def header():
        reads.append(1)
        return source.sales_order_header

    source = standin_tables(spark, SF)
    from ledgerlens.sources.tables import Tables

    t = Tables(sales_order_header=header)
    for name in ("rfm_customers", "rfm_segments", "d9_segment_rollup"):
        p = plan(run(name, t, STANDIN_PARAMS))
        assert "orders.parquet" not in p, name  # only the stored customer table is read
        assert "rfm_customers-" in p, name
    assert reads == [1]


def test_replaced_files_are_seen(spark, tmp_path):
    def put(n):
        spark.createDataFrame([(i, i, "1-URGENT", "F", 10.0, datetime(2000, 1, 1)) for i in range(n)], ORDERS).write.mode(
            "overwrite"
        ).parquet(str(tmp_path / "orders.parquet"))

    put(3)
    assert sum(r["OrderCount"] for r in run("q3_channel_share", standin_tables(spark, str(tmp_path)), STANDIN_PARAMS).collect()) == 3
    put(7)
    assert sum(r["OrderCount"] for r in run("q3_channel_share", standin_tables(spark, str(tmp_path)), STANDIN_PARAMS).collect()) == 7


ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
