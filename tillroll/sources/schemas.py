"""Table schemas. Raw widths and column names are fixed values of the providers' files."""

from __future__ import annotations

# Raw columns of each provider file with their widths, in file order.
RAW: dict[str, dict[str, int]] = {
    "apple": {
        "provider": 255,
        "provider_country": 80,
        "sku": 80,
        "developer": 255,
        "title": 255,
        "version": 80,
        "product_type_identifier": 80,
        "units": 80,
        "developer_proceeds": 80,
        "begin_date": 80,
        "end_date": 80,
        "customer_currency": 80,
        "country_code": 80,
        "currency_of_proceeds": 80,
        "apple_identifier": 80,
        "customer_price": 80,
        "promo_code": 80,
        "parent_identifier": 255,
        "subscription": 80,
        "period": 80,
        "category": 255,
        "cmb": 255,
        "device": 80,
        "supported_platforms": 255,
        "proceeds_reason": 255,
        "preserved_pricing": 255,
        "client": 255,
        "order_type": 255,
    },
    "amazon": {
        "marketplace": 40,
        "country_region_code": 40,
        "invoice_id": 100,
        "transaction_id": 40,
        "transaction_time": 80,
        "transaction_type": 40,
        "adjustment": 20,
        "asin": 40,
        "vendor_sku": 255,
        "title": 255,
        "item_name": 255,
        "item_type": 255,
        "in_app_subscription_term": 40,
        "in_app_subscription_status": 40,
        "units": 80,
        "usage_time_for_underground_apps_seconds": 80,
        "marketplace_currency": 40,
        "sales_price_marketplace_currency": 80,
        "estimated_earnings_marketplace_currency": 80,
        "digital_order_id": 80,
        "app_user_id": 80,
        "receipt_id": 80,
        "sales_channel": 80,
        "device_type": 80,
        "device_os": 80,
    },
    "google": {
        "order_number": 100,
        "order_charged_date": 80,
        "order_charged_timestamp": 80,
        "financial_status": 80,
        "device_model": 255,
        "product_title": 255,
        "product_id": 255,
        "product_type": 80,
        "sku_id": 255,
        "hardware": 80,
        "buyer_country": 80,
        "buyer_state": 80,
        "buyer_postal_code": 80,
        "buyer_currency": 20,
        "amount_buyer_currency": 80,
        "currency_of_sale": 20,
        "amount_merchant_currency": 80,
    },
    "roku": {
        "transaction_id": 80,
        "channel_id": 80,
        "channel_name": 255,
        "product_id": 255,
        "product_name": 255,
        "product_type": 80,
        "transaction_type": 80,
        "transaction_date": 80,
        "amount": 80,
        "currency": 20,
        "country_code": 20,
        "user_id": 80,
    },
    "direct_billing": {
        "transaction_id": 80,
        "user_id": 80,
        "transaction_status": 80,
        "transaction_type": 80,
        "product_name": 80,
        "product_description": 80,
        "payment_period": 80,
        "amount": 80,
        "currency": 80,
        "vat": 80,
        "subscription_id": 80,
        "refunded_transaction_id": 80,
        "created_timestamp": 80,
        "updated_timestamp": 80,
        "charged_timestamp": 80,
        "payment_country": 80,
        "card_provider": 80,
        "vendor_reference_id": 80,
        "price_plan_id": 80,
        "vat_amount": 80,
        "sales_tax_amount": 80,
        "invoice_id": 80,
        "merchant_reference_id": 80,
        "payment_provider": 80,
        "payment_type": 80,
        "geo_location_country_iso": 80,
        "geo_location_subdivision_iso": 80,
        "refunder_user_id": 80,
        "refund_reason": 3000,
        "invoice_generated_timestamp": 80,
        "realm": 80,
        "global_subscription_id": 80,
        "installment_details_number_of_installments": 40,
        "items_item_id": 80,
        "e_invoice_id": 80,
        "pay_per_view_access_id": 80,
    },
}
LINEAGE = ("load_tx_id", "file_tx_id")
PROVIDERS = tuple(RAW)

# Channel name and number of each provider.
CHANNELS = {
    "apple": ("Apple", 1),
    "google": ("Google", 2),
    "amazon": ("Amazon", 3),
    "roku": ("Roku", 4),
    "direct_billing": ("DirectBilling", 5),
}

# Typed columns that are not strings; everything else keeps its raw type.
TYPED = {
    "apple": {
        "units": "int",
        "developer_proceeds": "decimal(20,6)",
        "begin_date": "date",
        "end_date": "date",
        "customer_price": "decimal(20,6)",
    },
    "amazon": {
        "transaction_time_local": "timestamp_ntz",
        "transaction_time_utc": "timestamp_ntz",
        "units": "int",
        "usage_time_for_underground_apps_seconds": "decimal(20,6)",
        "sales_price_marketplace_currency": "decimal(20,6)",
        "estimated_earnings_marketplace_currency": "decimal(20,6)",
    },
    "google": {
        "order_charged_date": "date",
        "order_charged_timestamp": "timestamp_ntz",
        "amount_buyer_currency": "decimal(20,6)",
        "amount_merchant_currency": "decimal(20,6)",
    },
    "roku": {"transaction_date": "timestamp_ntz", "amount": "decimal(20,6)"},
    "direct_billing": {
        "amount": "decimal(20,6)",
        "vat": "decimal(20,6)",
        "vat_amount": "decimal(20,6)",
        "sales_tax_amount": "decimal(20,6)",
        "subscription_id": "int",
        "installment_details_number_of_installments": "int",
        "created_timestamp": "timestamp_ntz",
        "updated_timestamp": "timestamp_ntz",
        "charged_timestamp": "timestamp_ntz",
    },
}

# The payment fact, 37 columns in table order, and the day of utc_timestamp, which scans can skip by.
PAYMENTS = {
    "company_account": "string",
    "merchant_account": "string",
    "psp_reference": "string",
    "local_timestamp": "timestamp_ntz",
    "timezone": "string",
    "utc_timestamp": "timestamp_ntz",
    "utc_date": "date",
    "main_currency": "string",
    "main_amount": "decimal(20,6)",
    "payment_currency": "string",
    "vat": "decimal(20,6)",
    "net": "decimal(20,6)",
    "record_type": "string",
    "name": "string",
    "type": "string",
    "invoice_number": "string",
    "receipt_id": "string",
    "issuer_country": "string",
    "pmt_channel": "string",
    "pmt_channel_nr": "smallint",
    "pmt_ra_status": "smallint",
    "transaction_id": "string",
    "adjustment": "string",
    "asin": "string",
    "vendor_sku": "string",
    "in_app_subscription_term": "string",
    "in_app_subscription_status": "string",
    "digital_order_id": "string",
    "app_user_id": "string",
    "sales_channel": "string",
    "hardware": "string",
    "product_id": "string",
    "product_title": "string",
    "record_key": "string",
    "fact_etl_revision": "string",
    "file_tx_region": "string",
    "load_tx_id": "string",
    "file_tx_id": "string",
}

SKUS = {
    "payment_provider": "string",
    "realm": "string",
    "source_region": "string",
    "file_tx_region": "string",
    "sku_id": "string",
    "payment_period": "string",
    "tier_type": "string",
    "included_in_accrual_yn": "string",
    "partner_revenue_share": "decimal(20,6)",
    "sku_create_timestamp": "timestamp_ntz",
    "auto_generated_yn": "string",
}
SKU_KEY = ("payment_provider", "sku_id", "file_tx_region")

# What of each file is in force: the generation that readers see (below zero: none) and its days.
FILE_SETS = {
    "pmt_channel": "string",
    "file_tx_id": "string",
    "generation": "bigint",
    "stored": "bigint",  # the generation of its payments, or the closing that has taken them in
    "first_day": "date",
    "last_day": "date",
    "file_rows": "bigint",
}
# Subscribers of a part (provider, realm, region, status) as bits over dense numbers.
SUBSCRIBER_BITMAPS = {
    "payment_provider": "string",
    "realm": "string",
    "source_region": "string",
    "status": "string",
    "bucket": "bigint",
    "bits": "binary",
    "subscriptions": "bigint",
    "as_of": "date",
}
# Revenue of a SKU in a file, summed as promotion counts it.
SKU_SALES = {
    "payment_provider": "string",
    "sku_id": "string",
    "file_tx_region": "string",
    "value": "decimal(38,6)",
    "file_tx_id": "string",
    "generation": "bigint",
}
# The two sides of a reconciliation, and what a match says of them.
PSP_PAYMENTS = {
    "payment_id": "bigint",
    "merchant_account": "string",
    "record_type": "string",
    "psp_reference": "string",
    "merchant_reference": "string",
    "invoice_number": "string",
    "event_code": "string",
    "product_id": "string",
    "subscription_id": "bigint",
    "amount": "decimal(20,6)",
    "currency": "string",
    "utc_timestamp": "timestamp_ntz",
}
PSP_CHARGES = {
    "charge_id": "bigint",
    "merchant_account": "string",
    "transaction_type": "string",
    "psp_reference": "string",
    "vendor_reference_id": "string",
    "merchant_reference": "string",
    "invoice_id": "string",
    "product_id": "string",
    "subscription_id": "bigint",
    "amount": "decimal(20,6)",
    "currency": "string",
    "charged_timestamp": "timestamp_ntz",
}
RECON_DETAIL = {
    "recon_date": "date",
    "state": "string",
    "payment_id": "bigint",
    "charge_id": "bigint",
    "subscription_id": "bigint",
    "psp_reference": "string",
    "merchant_account": "string",
    "record_type": "string",
    "product_id": "string",
    "payment_amount": "decimal(20,6)",
    "charge_amount": "decimal(20,6)",
}
# Lines of provider files that are no rows of the raw tables.
REJECTS = {
    "provider": "string",
    "line": "string",
    "reason": "string",
    "load_tx_id": "string",
    "file_tx_id": "string",
}
# Which epochs of a log count: from read_from on; what is appended goes to write_epoch.
LOG_HEADS = {"log": "string", "read_from": "bigint", "write_epoch": "bigint", "event_seq": "bigint"}

COLLECTION_AUDIT = {
    "file_tx_id": "string",
    "data_source": "string",
    "collection_type": "string",
    "data_file": "string",
    "data_file_timestamp": "timestamp_ntz",
    "tx_row_count": "bigint",
}
LOAD_AUDIT = {
    "file_tx_id": "string",
    "data_source": "string",
    "data_file": "string",
    "status": "string",
    "record_count_staging": "bigint",
    "load_date_time": "timestamp_ntz",
}
MONITOR_CONFIG = {
    "mv_id": "string",
    "mv_status": "string",
    "data_source": "string",
    "collection_type": "string",
    "mv_range_in_months": "int",
    "mv_created_timestamp": "timestamp_ntz",
    "mv_updated_timestamp": "timestamp_ntz",
    "mv_min_date": "date",
    "mv_max_date": "date",
    "mv_row_count": "bigint",
}
MASTER = {
    "mv_id": "string",
    "data_source": "string",
    "collection_type": "string",
    "file_date": "date",
    "data_file": "string",
    "file_tx_id": "string",
    "load_status": "string",
    "files_collected": "bigint",
    "records_audit_trail": "bigint",
    "raw_file_count": "bigint",
    "raw_transaction_count": "bigint",
    "final_file_count": "bigint",
    "final_transaction_count": "bigint",
    "fact_file_count": "bigint",
    "fact_transaction_count": "bigint",
    "fact_recorded_file_count": "bigint",
    "overwritten": "bigint",
    "pct_fact": "double",
    "fact_recorded_transaction_count": "bigint",
    "variance": "double",
}


def raw_widths(provider: str) -> dict[str, int]:
    """Column widths of a provider's file, in file order."""
    return dict(RAW[provider])


def raw_schema(provider: str) -> dict[str, str]:
    """The raw table: every file column a string, then the lineage."""
    return dict.fromkeys([*raw_widths(provider), *LINEAGE], "string")


def typed_schema(provider: str) -> dict[str, str]:
    """The typed table, in table order."""
    names = list(raw_widths(provider))
    if provider == "amazon":
        at = names.index("transaction_time")
        names[at : at + 1] = [
            "transaction_time_local", "transaction_time_local_tz", "transaction_time_utc",
        ]
    if provider != "direct_billing":
        names.append("file_tx_region")
    return {n: TYPED[provider].get(n, "string") for n in [*names, *LINEAGE]}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
