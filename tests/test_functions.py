"""Column helpers: guarded rates, rounding, labels."""

from __future__ import annotations

from decimal import Decimal as D


from ledgerlens.functions.labels import channel_by_flag, label_by_prefix, rfm_code
from ledgerlens.functions.measures import pct, rate, ratio


def test_pct_guards_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0), (2.345, 100.0), (-2.345, 100.0)], "n double, d double")
    out = df.select(
        pct("n", "d", 10, 4).alias("null_guard"), pct("n", "d", 10, 4, on_zero="zero").alias("zero_guard")
    ).collect()
    assert out[0]["null_guard"] == D("33.3333")
    assert out[1]["null_guard"] is None and out[1]["zero_guard"] == D("0.0000")
    per_one = [r[0] for r in df.select(rate("n", "d", 10, 4)).collect()]
    assert per_one == [D("0.3333"), None, D("0.0235"), D("-0.0235")]
    assert [r[0] for r in df.select(ratio("n", "d")).collect()][1] is None
    assert out[2]["null_guard"] == D("2.3450") and out[3]["null_guard"] == D("-2.3450")


def test_label_by_prefix_first_match(spark):
    df = spark.createDataFrame([("Road-150 X",), ("HL Road-150",), ("Road-650",), ("Other",)], "n string")
    lab = label_by_prefix("n", [("H", ["Road-150", "Mountain"]), ("L", ["Road-650"])], "O")
    assert [r[0] for r in df.select(lab).collect()] == ["H", "O", "L", "O"]


def test_channel_flag_null_is_offline(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "f int")
    assert [r[0] for r in df.select(channel_by_flag("f")).collect()] == ["Online", "Offline", "Offline"]


def test_rfm_code_skips_nulls(spark):
    df = spark.createDataFrame([(4, 1, 1), (None, None, 3)], "r int, f int, m int")
    assert [r[0] for r in df.select(rfm_code("r", "f", "m")).collect()] == ["411", "3"]


def test_cast_rounds_half_away_from_zero(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        F.lit(2.345).cast("decimal(10,2)").alias("p"), F.lit(-2.345).cast("decimal(10,2)").alias("n")
    ).first()
    assert (row["p"], row["n"]) == (D("2.35"), D("-2.35"))


def test_rate_overflow_raises_under_ansi(spark):
    import pytest
    from pyspark.errors import ArithmeticException, SparkRuntimeException

    df = spark.createDataFrame([(20.0, 1.0)], "n double, d double")  # 2000 % does not fit DECIMAL(5,2)
    with pytest.raises((ArithmeticException, SparkRuntimeException)):
        df.select(pct("n", "d", 5, 2)).collect()
