"""Accrual and straight-line deferral of subscription revenue, and the daily rates it needs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.clock import days_in_month, days_to_next_year, rolling_months
from tillroll.functions.money import MONEY, RATE, TOTAL
from tillroll.functions.text import by_value
from tillroll.operators.lookups import unique_lookup
from tillroll.operators.skus import subscription_rows
from tillroll.sources.schemas import SKU_KEY

WINDOW_MONTHS = 24

# The regions accrued, and the tags each region stands for.
REGIONS = ("AMER", "EMEA", "MAX", "ESP", "CNN")
SOURCE_REGIONS = {"MAX": "max", "AMER": "amer", "EMEA": "emea"}
REALMS = {
    "AMER": "go",
    "EMEA": "dplay",
    "MAX": "streaming",
    "ESP": "eurosport",
    "INDIA": "streaming_india",
}
COMPANIES = {
    "AMER": "StreamCo",
    "EMEA": "StreamCo",
    "ESP": "StreamCo",
    "MAX": "MaxStream",
    "CNN": "MaxStream",
}
REPORTING_CURRENCIES = {
    "eurosport": "EUR",
    "dplay": "GBP",
    "go": "USD",
    "streaming_india": "INR",
    "streaming": "USD",
}
SHARE_COUNTRIES = ("gb", "uk", "gg", "gi", "ie", "im", "je")


@dataclass(frozen=True)
class AccrualLookups:
    """The five reference tables an accrual joins to."""

    fallback_country: DataFrame
    skus: DataFrame
    exchange_rates: DataFrame
    vat: DataFrame
    commission: DataFrame


def daily_average_rates(quotes: DataFrame) -> DataFrame:
    """One rate per currency and day: the mean of the day's quotes."""
    return quotes.groupBy(
        "currency_code", F.col("quoted_at").cast("date").alias("exchange_rate_date")
    ).agg(F.avg("exchange_rate").cast(MONEY).alias("exchange_rate"))


def _divide(value: Column, by: Column, kind: str) -> Column:
    """A quotient rounded to a column type; NULL for a zero divisor."""
    return (value / F.nullif(by, F.lit(0))).cast(kind)


def _payments(payments: DataFrame, as_of: date, channels: Sequence[str]) -> DataFrame:
    region = F.col("file_tx_region")
    wanted = (
        rolling_months(F.col("utc_date"), as_of, WINDOW_MONTHS)
        & region.isin(*REGIONS)
        & subscription_rows(channels)
    )
    amount = F.col("main_amount").cast(MONEY)
    return payments.where(wanted).select(
        F.col("pmt_channel").alias("payment_provider"),
        "psp_reference",
        F.col("vendor_sku").alias("product_name"),
        "net",
        amount.alias("main_amount"),
        F.lit(0).cast(MONEY).alias("sales_tax"),
        amount.alias("amount"),
        F.col("main_currency").alias("currency"),
        F.col("issuer_country").alias("subscribed_in_country"),
        F.col("record_type").alias("transaction_type"),
        by_value(region, REALMS, default=F.lit("")).alias("realm"),
        "file_tx_region",
        by_value(region, SOURCE_REGIONS).alias("source_region"),
        by_value(region, COMPANIES, default=F.lit("")).alias("company"),
        F.col("utc_timestamp").alias("created_timestamp"),
        F.col("utc_date").alias("_day"),
    )


def accrual(
    payments: DataFrame,
    lookups: AccrualLookups,
    as_of: date,
    channels: Sequence[str] = ("Amazon",),
) -> DataFrame:
    """One row per accrued payment, with rates, VAT, commission and daily deferral amounts.

    Money is rounded to six places column by column, so the stored columns add up.
    """
    base = _payments(payments, as_of, channels)

    eligible = lookups.skus.where(F.col("included_in_accrual_yn") == "Y").select(
        *SKU_KEY, "payment_period", "tier_type", "partner_revenue_share"
    )
    skus = unique_lookup(eligible, SKU_KEY, "SKU reference").where(
        F.col("payment_period").isin("MONTH", "YEAR")
    ).withColumnRenamed("sku_id", "product_name")
    rows = base.join(skus, ["product_name", "file_tx_region", "payment_provider"])

    fallback = unique_lookup(
        lookups.fallback_country.select("currency_code", "country_code"),
        ["currency_code"],
        "fallback country",
    ).select(F.col("currency_code").alias("currency"), F.col("country_code").alias("_fallback"))
    stated = F.trim(F.coalesce("subscribed_in_country", F.lit("")))
    country = F.when(stated.isin("", "**"), F.lower("_fallback")).otherwise(
        F.lower("subscribed_in_country")
    )
    area = F.when(
        (F.col("payment_provider") == "Amazon") & (F.col("company") != ""), F.lit("All")
    ).otherwise(F.lit(""))
    reporting = by_value(F.col("realm"), REPORTING_CURRENCIES, default=F.col("currency"))
    rows = rows.join(fallback, "currency", "left").select(
        "*",
        country.alias("country_code"),
        area.alias("commission_area"),
        reporting.alias("_reporting"),
    )

    daily = unique_lookup(
        lookups.exchange_rates.select("currency_code", "exchange_rate_date", "exchange_rate"),
        ["currency_code", "exchange_rate_date"],
        "exchange rates",
    )
    own_rate = daily.select(
        F.col("currency_code").alias("currency"),
        F.col("exchange_rate_date").alias("_day"),
        F.col("exchange_rate").alias("_rate"),
    )
    reporting_rate = daily.select(
        F.col("currency_code").alias("_reporting"),
        F.col("exchange_rate_date").alias("_day"),
        F.col("currency_code").alias("reporting_currency"),
        F.col("exchange_rate").alias("_reporting_rate"),
    )
    vat = unique_lookup(
        lookups.vat.select("country_code", F.col("vat_rate").cast("decimal(10,4)")),
        ["country_code"],
        "VAT rates",
    )
    commission = unique_lookup(
        lookups.commission.select(
            "company",
            F.col("provider").alias("payment_provider"),
            F.col("area").alias("commission_area"),
            F.col("commission_rate").cast("decimal(10,4)"),
        ),
        ["company", "payment_provider", "commission_area"],
        "commission rates",
    )
    rows = (
        rows.join(own_rate, ["currency", "_day"], "left")
        .join(reporting_rate, ["_reporting", "_day"], "left")
        .join(vat, "country_code", "left")
        .join(commission, ["company", "payment_provider", "commission_area"], "left")
    )

    rate = F.col("_rate")
    usd = (
        F.when(rate == 0, F.lit(0).cast(RATE))
        .when(F.col("currency") == "USD", F.lit(1).cast(RATE))
        .otherwise(_divide(F.lit(1), rate, RATE))
    )
    to_reporting = F.when(rate == 0, F.lit(0).cast(RATE)).otherwise(
        _divide(F.col("_reporting_rate"), rate, RATE)
    )
    days = F.when(
        F.col("payment_period") == "MONTH", days_in_month(F.col("created_timestamp"))
    ).otherwise(days_to_next_year(F.col("created_timestamp")))
    outside = (F.col("realm") == "eurosport") & ~F.col("country_code").isin(*SHARE_COUNTRIES)
    share = F.when(outside, F.lit(0).cast(MONEY)).otherwise(F.col("partner_revenue_share"))
    vat_rate = F.coalesce("vat_rate", F.lit(0).cast("decimal(10,4)"))
    gross = F.col("amount")

    return (
        rows.withColumn("vat_rate", vat_rate)
        .withColumn("vat_amount", gross - _divide(gross, F.lit(1) + F.col("vat_rate"), MONEY))
        .withColumn("vat_amount", F.col("vat_amount").cast(MONEY))
        .withColumn("revenue", (gross - F.col("vat_amount")).cast(MONEY))
        .withColumn("commission", (F.col("revenue") * F.col("commission_rate")).cast(MONEY))
        .withColumn("days_in_period", days)
        .select(
            "payment_provider",
            "psp_reference",
            "payment_period",
            "product_name",
            "tier_type",
            "net",
            "main_amount",
            "sales_tax",
            "amount",
            "currency",
            usd.alias("exchange_rate_to_usd"),
            "reporting_currency",
            to_reporting.alias("reporting_currency_exchange_rate"),
            "subscribed_in_country",
            "country_code",
            "transaction_type",
            "realm",
            "file_tx_region",
            "source_region",
            "company",
            "created_timestamp",
            "vat_rate",
            "vat_amount",
            "revenue",
            "commission_rate",
            "commission",
            "days_in_period",
            _divide(F.col("revenue"), F.col("days_in_period"), MONEY).alias("daily_revenue_rate"),
            _divide(F.col("commission"), F.col("days_in_period"), MONEY).alias(
                "daily_commission_rate"
            ),
            share.alias("partner_rev_share"),
        )
    )


def with_run_stamp(df: DataFrame) -> DataFrame:
    """Add the time of the run, as stored tables carry it."""
    return df.withColumn("mv_last_updated", F.current_timestamp())


def daily_accrual(accrued: DataFrame) -> DataFrame:
    """Daily revenue and commission by provider, realm, period and charge day."""
    return accrued.groupBy(
        "payment_provider",
        "realm",
        "payment_period",
        F.col("created_timestamp").cast("date").alias("charge_date"),
    ).agg(
        F.count("*").alias("charges"),
        F.sum("revenue").cast(TOTAL).alias("revenue"),
        F.sum("daily_revenue_rate").cast(TOTAL).alias("daily_revenue_rate"),
        F.sum("daily_commission_rate").cast(TOTAL).alias("daily_commission_rate"),
    )
