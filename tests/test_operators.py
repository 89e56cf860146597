"""Generic operators on small hand-made frames."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import (
    expect_no_rows,
    period_growth,
    quartile_score,
    ranked,
    share_of_total,
    top_n,
    top_n_per_group,
    with_totals,
)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("a", 1, D("10")), ("a", 2, D("30")), ("a", 3, D("30")), ("b", 4, D("40")), ("b", 5, D("0"))]
    return spark.createDataFrame(rows, "g string, id bigint, v decimal(20,4)")


def test_shares_agree(sales):
    a = {r["id"]: r["s"] for r in share_of_total(sales, "v", "s", 10, 4).collect()}
    total = with_totals(sales, sales.agg(F.sum("v").alias("all")))
    assert a[1] == D("9.0909") and a[5] == D("0.0000") and {r["all"] for r in total.collect()} == {D("110.0000")}
    groups = with_totals(sales, sales.groupBy("g").agg(F.sum("v").alias("all")), ["g"])
    assert {(r["g"], r["all"]) for r in groups.collect()} == {("a", D("70.0000")), ("b", D("40.0000"))}
    per = {r["id"]: r["s"] for r in share_of_total(sales, "v", "s", 10, 4, by=["g"]).collect()}
    assert per[1] == D("14.2857") and per[4] == D("100.0000")


def test_rank_kinds_and_top_n(sales):
    r = {x["id"]: x["r"] for x in ranked(sales, "v", "r", "rank", by=["g"]).collect()}
    d = {x["id"]: x["r"] for x in ranked(sales, "v", "r", "dense_rank").collect()}
    assert (r[2], r[3], r[1]) == (1, 1, 3) and (d[4], d[2], d[3], d[1], d[5]) == (1, 2, 2, 3, 4)
    top = top_n_per_group(sales, 1, "v", ["g"], "r").collect()
    assert sorted(x["id"] for x in top) == [2, 3, 4]  # a tie keeps both rows
    assert [x["id"] for x in top_n(sales, 2, [F.col("v").desc(), F.col("id").asc()]).collect()] == [4, 2]


def test_period_growth_guards_zero(spark):
    t = spark.createDataFrame(
        [(2020, 1, D("0")), (2020, 2, D("5")), (2020, 4, D("10"))],
        "OrderYear int, OrderQuarter int, rev decimal(38,4)",
    )
    g = period_growth(t, "rev", "prev", "chg", "pct").orderBy("OrderQuarter").collect()
    assert [x["prev"] for x in g] == [None, D("0.0000"), D("5.0000")]
    assert [x["pct"] for x in g] == [None, None, D("100.0000")]


def test_integrity_helpers(sales):
    keys = sales.sparkSession.createDataFrame([("a", 1), ("b", None)], "g string, store int")
    count = lambda rule, dim: expect_no_rows(sales, rule, keys, dim, "g", "id", "n").first()["n"]
    assert count(F.col("v") < 0, F.col("store").isNull()) == 0
    assert count(F.col("v") >= 0, F.col("store").isNull()) == 2
    assert count(F.col("v") > 10, F.col("store").isNotNull()) == 2


def test_quartile_score(sales):
    s = {r["id"]: r["q"] for r in quartile_score(sales, "v", "q").collect()}
    # percent ranks 0.25, 0.5, 0.5, 1.0, 0.0
    assert s == {5: 1, 1: 1, 2: 2, 3: 2, 4: 4}
    inv = {r["id"]: r["q"] for r in quartile_score(sales, "v", "q", ascending=False).collect()}
    assert inv == {k: 5 - v for k, v in s.items()}
