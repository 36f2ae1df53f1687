"""Typed provider rows to the unified payment fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.sources.schemas import CHANNELS, PAYMENTS

REVISION = "1.0.0"

# Fact column -> typed column, per provider. A fact column absent here is NULL.
MAPPING = {
    "amazon": {
        "company_account": "title",
        "merchant_account": "marketplace",
        "local_timestamp": "transaction_time_local",
        "timezone": "transaction_time_local_tz",
        "utc_timestamp": "transaction_time_utc",
        "main_currency": "marketplace_currency",
        "main_amount": "sales_price_marketplace_currency",
        "payment_currency": "marketplace_currency",
        "net": "estimated_earnings_marketplace_currency",
        "record_type": "transaction_type",
        "name": "item_name",
        "type": "item_type",
        "invoice_number": "invoice_id",
        "receipt_id": "receipt_id",
        "issuer_country": "country_region_code",
        "transaction_id": "transaction_id",
        "adjustment": "adjustment",
        "asin": "asin",
        "vendor_sku": "vendor_sku",
        "in_app_subscription_term": "in_app_subscription_term",
        "in_app_subscription_status": "in_app_subscription_status",
        "digital_order_id": "digital_order_id",
        "app_user_id": "app_user_id",
        "sales_channel": "sales_channel",
        "hardware": "device_type",
        "product_title": "device_os",
    },
    "google": {
        "psp_reference": "order_number",
        "utc_timestamp": "order_charged_timestamp",
        "main_currency": "buyer_currency",
        "main_amount": "amount_buyer_currency",
        "payment_currency": "currency_of_sale",
        "net": "amount_merchant_currency",
        "record_type": "financial_status",
        "type": "product_type",
        "issuer_country": "buyer_country",
        "vendor_sku": "sku_id",
        "hardware": "hardware",
        "product_id": "product_id",
        "product_title": "product_title",
    },
    "roku": {
        "psp_reference": "transaction_id",
        "utc_timestamp": "transaction_date",
        "main_currency": "currency",
        "main_amount": "amount",
        "payment_currency": "currency",
        "record_type": "transaction_type",
        "name": "product_name",
        "type": "product_type",
        "issuer_country": "country_code",
        "transaction_id": "transaction_id",
        "vendor_sku": "product_id",
        "app_user_id": "user_id",
        "product_id": "product_id",
    },
    "direct_billing": {
        "merchant_account": "payment_provider",
        "psp_reference": "vendor_reference_id",
        "utc_timestamp": "charged_timestamp",
        "main_currency": "currency",
        "main_amount": "amount",
        "payment_currency": "currency",
        "vat": "vat_amount",
        "record_type": "transaction_type",
        "name": "product_name",
        "type": "payment_type",
        "invoice_number": "invoice_id",
        "issuer_country": "payment_country",
        "transaction_id": "transaction_id",
        "app_user_id": "user_id",
    },
}


def record_key(reference: Column, utc: Column, record_type: Column) -> Column:
    """`reference~time~type~`; NULL when the time or the type is."""
    tilde = F.lit("~")
    return F.concat(
        F.coalesce(reference, F.lit("")), tilde, utc.cast("string"), tilde, record_type, tilde
    )


def to_fact(provider: str, typed: DataFrame) -> DataFrame:
    """The payment fact rows of a provider's typed rows; Apple has a fact of its own."""
    mapping = MAPPING[provider]
    channel, number = CHANNELS[provider]
    key_source = "receipt_id" if provider == "amazon" else mapping["psp_reference"]
    values = {name: F.col(source) for name, source in mapping.items()}
    values["pmt_channel"] = F.lit(channel)
    values["pmt_channel_nr"] = F.lit(number)
    values["pmt_ra_status"] = F.lit(0)
    values["fact_etl_revision"] = F.lit(REVISION)
    values["record_key"] = record_key(
        F.col(key_source), values["utc_timestamp"], values["record_type"]
    )
    if provider == "amazon":
        values["psp_reference"] = F.coalesce("receipt_id", F.lit(""))
    values["utc_date"] = values["utc_timestamp"].cast("date")
    values.setdefault("vat", F.lit(0))
    values.setdefault("local_timestamp", values["utc_timestamp"])
    values.setdefault("timezone", F.lit("UTC"))
    for name in ("file_tx_region", "load_tx_id", "file_tx_id"):
        if name in typed.columns:
            values[name] = F.col(name)
    return typed.select(
        *[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in PAYMENTS.items()]
    )


def to_apple_fact(typed: DataFrame) -> DataFrame:
    """Apple sales keep their own fact, with the typed columns."""
    return typed


def without_files(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The fact without the rows of the given files (column file_tx_id)."""
    return facts.join(files.select("file_tx_id"), "file_tx_id", "left_anti").select(*facts.columns)


def replace_file(facts: DataFrame, incoming: DataFrame, file_tx_id: str) -> DataFrame:
    """What the fact holds after a load: the file's old rows gone, its new rows in."""
    kept = facts.where(~F.col("file_tx_id").eqNullSafe(F.lit(file_tx_id)))
    new = incoming.where(F.col("file_tx_id") == file_tx_id)
    return kept.unionByName(new)
