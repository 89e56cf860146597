"""PERCENT_RANK tiers without a global window == the window form, ties included."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.quantiles import percent_rank_tiers
from ledgerlens.params import REFERENCE_PARAMS
from ledgerlens.plans import rfm
from ledgerlens.schema import SCHEMAS

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("a", T.DecimalType(20, 4)),
        T.StructField("b", T.LongType()),
        T.StructField("c", T.IntegerType()),
    ]
)


def window_form(df, col, desc):
    pr = F.percent_rank().over(Window.orderBy(F.col(col).asc_nulls_first()))
    t = F.when(pr <= 0.25, 1).when(pr <= 0.5, 2).when(pr <= 0.75, 3).otherwise(4)
    return (5 - t) if desc else t


def check(spark, data, ranges):
    df = spark.createDataFrame(data, SCHEMA)
    got = percent_rank_tiers(df, {"A": ("a", False), "B": ("b", False), "C": ("c", True)}, ranges=ranges)
    want = df.select(
        "id",
        window_form(df, "a", False).alias("A"),
        window_form(df, "b", False).alias("B"),
        window_form(df, "c", True).alias("C"),
    )
    g = {r["id"]: (r["A"], r["B"], r["C"]) for r in got.collect()}
    w = {r["id"]: (r["A"], r["B"], r["C"]) for r in want.collect()}
    assert g == w


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_random_with_ties(spark, seed, ranges):
    rnd = random.Random(seed)
    n = rnd.choice([1, 2, 5, 9, 13, 40, 157])
    data = [
        (
            i,
            D(rnd.choice([1, 2, 2, 3, 5, 8, 13, 21])) + D(rnd.randint(0, 3)) / 4,
            rnd.randint(1, 4),
            rnd.choice([None, 0, 1, 1, 7, 30]) if rnd.random() < 0.9 else None,
        )
        for i in range(n)
    ]
    check(spark, data, ranges)


def test_exact_quarter_boundaries_fall_in_lower_tier(spark):
    # n = 5 and n = 9: ranks exactly 0.25 / 0.5 / 0.75 exist.
    for n, want in [(5, [1, 1, 2, 3, 4]), (9, [1, 1, 1, 2, 2, 3, 3, 4, 4])]:
        data = [(i, D(i), i, i) for i in range(n)]
        df = spark.createDataFrame(data, SCHEMA)
        got = percent_rank_tiers(df, {"tierA": ("a", False)}).orderBy("id").select("tierA").collect()
        assert [r["tierA"] for r in got] == want


def _header(spark, rows):
    full = [
        (i, f"SO{i}", cust, None, 1, ts, 5, D(str(v)).quantize(D("0.0001")), 1)
        for i, (cust, ts, v) in enumerate(rows, start=1)
    ]
    return spark.createDataFrame(full, SCHEMAS["sales_order_header"])


def _rfm(spark, rows, as_of="2014-06-30"):
    p = REFERENCE_PARAMS.with_(as_of=as_of)
    return {r["CustomerID"]: r.asDict() for r in rfm.score(rfm.customer_measures(_header(spark, rows), p.as_of), p).collect()}


def test_single_customer_is_recent(spark):
    out = _rfm(spark, [(1, datetime(2014, 1, 1), 10)])
    assert (out[1]["RFM"], out[1]["Cus_Category"]) == ("411", "Recent Customer")


def test_equal_order_counts_give_frequency_1(spark):
    out = _rfm(spark, [(c, datetime(2014, 1, c), 10 * c) for c in range(1, 8)])
    assert {r["Frequency"] for r in out.values()} == {1}


def test_gap_counts_calendar_days(spark):
    out = _rfm(spark, [(1, datetime(2014, 6, 29, 23, 59), 10)])
    assert out[1]["GapDay"] == 1


def test_null_customer_keeps_only_monetary(spark):
    out = _rfm(spark, [(None, datetime(2014, 1, 1), 500), (1, datetime(2014, 1, 1), 5), (2, datetime(2014, 2, 1), 6)])
    n = out[None]
    assert n["Frequency"] is None and n["Recency"] is None and n["TotalOrder"] is None and n["GapDay"] is None
    assert n["RFM"] == str(n["Monetary"]) == "4"




@pytest.mark.parametrize(
    "code,label",
    [
        ("444", "Best Customer"),
        ("434", "Loyal High Value"),
        ("314", "Potential Loyal"),
        ("224", "Almost Big Customer"),
        ("114", "Lost Big Customer"),
        ("123", "At Risk"),
        ("211", "Almost Lost"),
        ("421", "Recent Customer"),
        ("331", "Other"),
        ("323", "Other"),
        ("4", "Recent Customer"),
    ],
)
def test_segment_rules(spark, code, label):
    from ledgerlens.functions.labels import segment_by_rules
    from ledgerlens.params import SEGMENT_DEFAULT, SEGMENT_RULES

    df = spark.createDataFrame([(code,)], "RFM string")
    assert df.select(segment_by_rules("RFM", SEGMENT_RULES, SEGMENT_DEFAULT).alias("s")).first()["s"] == label


def test_invariant_under_repartition(spark):
    rnd = random.Random(7)
    data = [(i, D(rnd.randint(1, 50)), rnd.randint(1, 5), rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    spec = {"A": ("a", False), "B": ("b", False), "C": ("c", True)}
    base = sorted(tuple(r) for r in percent_rank_tiers(df, spec).collect())
    for k in (1, 5, 17):
        again = sorted(tuple(r) for r in percent_rank_tiers(df.repartition(k), spec, ranges=k).collect())
        assert again == base


def agree(spark, df, specs, ranges):
    got = {r["id"]: tuple(r[k] for k in specs) for r in percent_rank_tiers(df, specs, ranges=ranges).collect()}
    want = df.select("id", *[window_form(df, c, desc).alias(k) for k, (c, desc) in specs.items()]).collect()
    assert got == {r["id"]: tuple(r[k] for k in specs) for r in want}


@pytest.mark.parametrize("ranges", [None, 1, 4, 40])
def test_double_measure(spark, ranges):
    rnd = random.Random(5)
    data = [(i, None if rnd.random() < 0.05 else rnd.randint(0, 30) * 0.1) for i in range(300)]
    agree(spark, spark.createDataFrame(data, "id bigint, x double"), {"tx": ("x", False)}, ranges)


@pytest.mark.parametrize("ranges", [None, 1, 4])
def test_bigint_beside_a_double_keeps_its_digits(spark, ranges):
    data = [(i, 2**60 + i, i * 0.5) for i in range(8)]
    df = spark.createDataFrame(data, "id bigint, a bigint, b double")
    agree(spark, df, {"A": ("a", False), "B": ("b", True)}, ranges)
    got = [r["A"] for r in percent_rank_tiers(df, {"A": ("a", False), "B": ("b", False)}, ranges=ranges).orderBy("id").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_nan_infinity_and_heavy_ties(spark, ranges):
    inf, nan = float("inf"), float("nan")
    values = [nan, nan, inf, -inf, inf, None, 0.0, -0.0, 1.5, 1.5, 1.5, 1.5, 1.5, 1.5, 2.0, nan, -inf]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, x double")
    agree(spark, df, {"t": ("x", False), "u": ("x", True)}, ranges)


@pytest.mark.parametrize("ranges", [1, 5])
def test_dates_and_timestamps(spark, ranges):
    rnd = random.Random(9)
    data = [
        (i, date(2020, 1, 1) + timedelta(days=rnd.randint(0, 20)), datetime(2020, 1, 1) + timedelta(seconds=rnd.randint(0, 50)))
        for i in range(80)
    ] + [(80, None, None)]
    df = spark.createDataFrame(data, "id bigint, d date, s timestamp")
    agree(spark, df, {"D": ("d", False), "S": ("s", True)}, ranges)


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError, match="cannot rank a string"):
        percent_rank_tiers(spark.createDataFrame([("a",)], "x string"), {"t": ("x", False)})


@pytest.mark.parametrize("ranges", [2, 3, 7, 8, 9, 10_000])
def test_many_ranges_equal_the_window_form(spark, ranges):
    rnd = random.Random(ranges)
    data = [(i, D(rnd.randint(-5000, 5000)) / 4, rnd.choice([None, 2**60 + i, i % 7]), rnd.randint(0, 900)) for i in range(3000)]
    check(spark, data, ranges)


def test_code_does_not_grow_with_the_ranges(spark):
    """The boundaries are data: a plan of ten thousand ranges has no more expressions than one of ten."""
    from ledgerlens.operators.quantiles import percent_rank_cuts

    df = spark.range(5000).selectExpr("id", "cast(id * id % 9973 as decimal(12,2)) as a")

    def cases(ranges):
        plan = percent_rank_cuts(df, {"t": "a"}, ranges=ranges)._jdf.queryExecution().analyzed().toString()
        return plan.count("CASE WHEN"), plan.count("element_at")

    assert cases(10) == cases(10_000)


def test_range_of_a_value_is_the_number_of_lower_bounds(spark):
    from ledgerlens.operators.quantiles import range_of

    for n in (0, 1, 2, 3, 6, 7, 8, 30):
        bounds = [2 * k for k in range(n)]
        array = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
        rows = spark.range(-3, 2 * n + 3).select("id", range_of(F.col("id"), array, n + 1).alias("r")).collect()
        assert [r.r for r in rows] == [sum(b < r.id for b in bounds) for r in rows]
