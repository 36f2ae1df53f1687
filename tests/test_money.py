from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions.money import (
    exponent,
    format_amount,
    is_three_decimal,
    is_zero_decimal,
    minor_to_major,
    normalise_amounts,
    round_to_exponent,
)

# Minor units, currency, major units as text: each exponent, padding, case and sign.
CASES = [
    (7, "SEK", "0.07"),
    (123456, "PLN", "1234.56"),
    (40, "CHF", "0.40"),
    (3, "BHD", "0.003"),
    (20480, "TND", "20.480"),
    (1, "KRW", "1"),
    (0, "VND", "0"),
    (86, "xaf", "86"),
    (61005, "\tNok ", "610.05"),
    (2750, " jod", "2.750"),
    (-5, "CAD", "-0.05"),
    (-1001, "IQD", "-1.001"),
]


def test_minor_units_by_currency(spark):
    df = spark.createDataFrame([(a, c) for a, c, _ in CASES], "amount bigint, currency string")
    rows = normalise_amounts(df, "amount", "currency").withColumn(
        "shown", format_amount(F.col("amount_normalised"), F.col("currency"))
    )
    assert [r.shown for r in rows.collect()] == [text for _, _, text in CASES]
    assert all(
        r.amount_normalised == Decimal(t) for r, (_, _, t) in zip(rows.collect(), CASES)
    )


def test_null_amount_and_unknown_currency(spark):
    df = spark.createDataFrame([(None, "USD"), (500, None), (500, "ZZZ")], "a bigint, c string")
    rows = df.select(minor_to_major(F.col("a"), F.col("c")).alias("v")).collect()
    assert [r.v for r in rows] == [None, Decimal("5.000000"), Decimal("5.000000")]


def test_staging_keeps_six_digits_and_rounding_is_half_up(spark):
    df = spark.createDataFrame([("10.5", "USD"), ("12345.6789", "KWD")], "a string, c string")
    major = minor_to_major(F.col("a"), F.col("c"))
    rows = df.select(major.alias("m"), round_to_exponent(major, F.col("c")).alias("r")).collect()
    assert [(r.m, r.r) for r in rows] == [
        (Decimal("0.105000"), Decimal("0.110000")),
        (Decimal("12.345679"), Decimal("12.346000")),
    ]


def test_exponents(spark):
    df = spark.createDataFrame([("JPY",), ("BHD",), ("EUR",)], "c string")
    code = F.col("c")
    rows = df.select(
        exponent(code).alias("e"), is_zero_decimal(code).alias("z"), is_three_decimal(code).alias("t")
    ).collect()
    assert [(r.e, r.z, r.t) for r in rows] == [(0, True, False), (3, False, True), (2, False, False)]


@pytest.mark.parametrize("amount", ["1e20", "123456789012345678.1", "abc"])
def test_amounts_that_do_not_fit_raise(spark, amount):
    df = spark.createDataFrame([(amount, "USD")], "a string, c string")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_INVALID_INPUT"):
        df.select(minor_to_major(F.col("a"), F.col("c"))).collect()
