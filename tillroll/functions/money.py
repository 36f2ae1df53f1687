"""Minor-unit conversion, rounding and formatting by ISO 4217 exponent."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"
RATE = "decimal(20,10)"
TOTAL = "decimal(38,6)"

# Currencies whose minor unit is a thousandth, and those that have none.
THREE_DECIMAL = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")
ZERO_DECIMAL = (
    "BIF", "CLP", "CVE", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW",
    "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF",
)


def _by_exponent(currency: Column, three: Column, zero: Column, two: Column) -> Column:
    code = F.upper(F.trim(currency))
    return (
        F.when(code.isin(*THREE_DECIMAL), three)
        .when(code.isin(*ZERO_DECIMAL), zero)
        .otherwise(two)
    )


def exponent(currency: Column) -> Column:
    """Digits after the point for a currency code; 2 unless listed."""
    return _by_exponent(currency, F.lit(3), F.lit(0), F.lit(2))


def is_zero_decimal(currency: Column) -> Column:
    return exponent(currency) == 0


def is_three_decimal(currency: Column) -> Column:
    return exponent(currency) == 3


def minor_to_major(amount: Column, currency: Column) -> Column:
    """Provider minor units to major units, scale 6, without rounding to the currency.

    The factor is a decimal literal, so this is one exact multiplication and not a division.
    """
    factor = _by_exponent(
        currency, F.lit(Decimal("0.001")), F.lit(Decimal("1.000")), F.lit(Decimal("0.010"))
    )
    return (amount.cast(MONEY) * factor).cast(MONEY)


def round_to_exponent(amount: Column, currency: Column) -> Column:
    """Half-up rounding to the currency's own digits."""
    value = amount.cast(MONEY)
    return _by_exponent(
        currency,
        F.round(value, 3).cast(MONEY),
        F.round(value, 0).cast(MONEY),
        F.round(value, 2).cast(MONEY),
    )


def format_amount(amount: Column, currency: Column) -> Column:
    """Text with exactly the currency's digits."""
    value = amount.cast(MONEY)
    return _by_exponent(
        currency,
        value.cast("decimal(20,3)").cast("string"),
        value.cast("decimal(20,0)").cast("string"),
        value.cast("decimal(20,2)").cast("string"),
    )


def normalise_amounts(
    df: DataFrame, amount: str, currency: str, out: str = "amount_normalised"
) -> DataFrame:
    """Add the major-unit amount, rounded to the currency, of a minor-unit column."""
    major = minor_to_major(F.col(amount), F.col(currency))
    return df.withColumn(out, round_to_exponent(major, F.col(currency)))
