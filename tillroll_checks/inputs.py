"""Domain tables derived from the driver tables, in SQL that Spark and DuckDB both read.

`{lineitem}` and the like stand for the driver tables. Every view covers whole tables: a remainder
only chooses a value, never which rows are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def pick(number: str, values: list[str]) -> str:
    """SQL that chooses among texts by remainder."""
    arms = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"case {number} % {len(values)} {arms} else '{values[-1]}' end"


REGIONS = ["AMER", "EMEA", "APAC", "MAX", "MAXTR", "CNN", "ESP", "MT", "INDIA", "DPLUS"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "KWD"]
PREFIXES = [
    "br_", "uk_", "de.", "stream.", "x.us.", "x.latam.", "golftv.", "dplus_", "ie_", "ca_", "us_",
    "a.lat.", "brx.", "x.foodnetwork.",
]
SUFFIXES = [
    ".annual", ".1m.svod", ".monthly.lite", ".12month.premium", ".ppv", ".1y.avod", ".year.light",
    ".12m.free", ".emea.month", ".apac.3month", ".plain",
]
CHANNELS = ["Amazon", "Google", "Roku", "Apple"]

REGION = pick("l_suppkey", REGIONS)
CURRENCY = pick("l_orderkey", CURRENCIES)
CHANNEL = pick("l_partkey", CHANNELS)
SKU = (
    f"concat({pick('l_partkey', PREFIXES)}, 'p', cast(l_partkey % 97 as string), "
    f"{pick('l_partkey', SUFFIXES)})"
)
AT = "l_shipdate + interval '1' second * ((l_orderkey * 37 + l_linenumber * 1009) % 86400)"
PRICE = "cast(l_extendedprice as decimal(20,6))"
AMOUNT = f"case when l_partkey % 29 = 0 then cast(0 as decimal(20,6)) else {PRICE} end"
SHIP_MONTH = "substr(cast(l_shipdate as string), 1, 7)"

VIEWS: dict[str, str] = {}

VIEWS["payments"] = f"""
select
  concat('acct', cast(l_suppkey % 3 as string)) as merchant_account,
  cast(l_orderkey as string) as psp_reference,
  {CHANNEL} as pmt_channel,
  {REGION} as file_tx_region,
  {SKU} as vendor_sku,
  case when l_returnflag = 'R' then 'Refund'
       when l_partkey % 4 = 0 then 'Charge'
       when l_partkey % 4 = 1 then 'Charged'
       when l_partkey % 4 = 2 and l_returnflag = 'A' then 'UpgradeSale'
       when l_partkey % 4 = 2 then 'Purchase'
       when l_returnflag = 'A' then 'Renewal' else 'New' end as record_type,
  case when l_linestatus = 'F' then 'Consumable'
       when l_partkey % 4 = 1 and l_linenumber % 2 = 0 then 'subscription'
       else 'Subscription' end as type,
  {CURRENCY} as main_currency,
  {AMOUNT} as main_amount,
  cast(l_extendedprice * (1 - l_discount) as decimal(20,6)) as net,
  {pick("l_orderkey", ["", "**", "GB", "DE", "us", "JP"])} as issuer_country,
  cast(l_orderkey as string) as receipt_id,
  {AT} as utc_timestamp, cast(l_shipdate as date) as utc_date,
  concat('f_', {CHANNEL}, '_', {REGION}, '_', {SHIP_MONTH}) as file_tx_id
from {{lineitem}}
"""

VIEWS["apple_sales"] = f"""
select {SKU} as sku,
  cast(case when l_partkey % 29 = 0 then 0 else l_extendedprice end as decimal(20,6))
    as customer_price,
  cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as int) as units,
  case when l_returnflag = 'N' then 'New' when l_returnflag = 'A' then 'Renewal'
       else 'Refund' end as subscription,
  cast(l_shipdate as date) as end_date,
  {pick("l_suppkey", [r for r in REGIONS if r != "MAXTR"])} as file_tx_region
from {{lineitem}}
"""

# Half of the SKUs are known already: those that some cheap sale has shown.
VIEWS["known_skus"] = f"""
select payment_provider, sku_id, file_tx_region,
  case when min(day) % 2 = 0 then 'Y' else 'N' end as auto_generated_yn,
  case when max(day) % 3 = 0 then 'Y' else 'N' end as included_in_accrual_yn
from (
  select {CHANNEL} as payment_provider, {SKU} as sku_id, {REGION} as file_tx_region,
    l_linenumber as day
  from {{lineitem}} where l_quantity <= 10
) k
group by payment_provider, sku_id, file_tx_region
"""

# Minor-unit amounts; some currency codes come padded or in lower case.
VIEWS["minor_amounts"] = f"""
select l_orderkey, l_linenumber,
  cast(round(l_extendedprice * 100) as bigint) as amount_minor,
  case when l_linenumber = 1 then lower({pick("l_orderkey", CURRENCIES + ["OMR", "CLP", "BIF"])})
       when l_linenumber = 2 then concat(' ', {pick("l_orderkey", CURRENCIES)}, ' ')
       else {pick("l_orderkey", CURRENCIES + ["OMR", "CLP", "BIF"])} end as currency
from {{lineitem}}
"""

TEXT_PRICE = f"cast({PRICE} as string)"

# Raw columns that no rule looks at, filled with their own name and a number.
PLAIN = {
    "raw_apple": [
        "provider", "provider_country", "developer", "version", "product_type_identifier",
        "country_code", "currency_of_proceeds", "apple_identifier", "promo_code",
        "parent_identifier", "period", "category", "cmb", "device", "supported_platforms",
        "proceeds_reason", "preserved_pricing", "client", "order_type",
    ],
    "raw_amazon": [
        "adjustment", "asin", "in_app_subscription_term", "in_app_subscription_status",
        "digital_order_id", "app_user_id", "sales_channel",
    ],
    "raw_google": [
        "device_model", "product_title", "hardware", "buyer_state", "buyer_postal_code",
    ],
    "raw_roku": ["channel_name"],
    "raw_billing": [
        "transaction_status", "product_name", "product_description", "payment_period",
        "refunded_transaction_id", "card_provider", "price_plan_id", "merchant_reference_id",
        "geo_location_country_iso", "geo_location_subdivision_iso", "refunder_user_id",
        "refund_reason", "global_subscription_id", "items_item_id", "e_invoice_id",
        "pay_per_view_access_id",
    ],
}


def plain(view_name: str) -> str:
    return ", ".join(
        f"concat('{name} ', cast(l_linenumber as string)) as {name}" for name in PLAIN[view_name]
    )


VIEWS["raw_apple"] = f"""
select {SKU} as sku, concat('app ', cast(l_suppkey as string)) as title,
  cast(cast(l_quantity as int) as string) as units,
  {TEXT_PRICE} as developer_proceeds,
  case when l_linenumber = 7 then '  '
       when l_linenumber % 2 = 0 then concat(cast(month(l_shipdate) as string), '/',
         cast(day(l_shipdate) as string), '/', cast(year(l_shipdate) as string))
       else concat(lpad(cast(month(l_shipdate) as string), 2, '0'), '/',
         lpad(cast(day(l_shipdate) as string), 2, '0'), '/', cast(year(l_shipdate) as string))
       end as begin_date,
  case when l_returnflag = 'R' then '' else concat(cast(month(l_shipdate) as string), '/',
         cast(day(l_shipdate) as string), '/', cast(year(l_shipdate) as string)) end as end_date,
  {CURRENCY} as customer_currency, {TEXT_PRICE} as customer_price,
  case when l_returnflag = 'N' then 'New' else 'Renewal' end as subscription,
  {plain("raw_apple")}, 'run1' as load_tx_id,
  concat('f_Apple_', {SHIP_MONTH}) as file_tx_id
from {{lineitem}}
"""

VIEWS["raw_amazon"] = f"""
select {pick("l_suppkey", ["amazon.com", "amazon.de", "amazon.co.jp"])} as marketplace,
  {pick("l_orderkey", ["US", "DE", "JP"])} as country_region_code,
  concat('i', cast(l_orderkey as string)) as invoice_id,
  concat('t', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as transaction_id,
  concat(cast({AT} as string), ' ', {pick("l_orderkey", ["UTC", "PST", "PDT", "EST"])})
    as transaction_time,
  case when l_returnflag = 'R' then 'Refund' else 'Charge' end as transaction_type,
  {SKU} as vendor_sku, concat('app ', cast(l_suppkey as string)) as title,
  'plan' as item_name,
  case when l_linestatus = 'O' then 'Subscription' else 'Consumable' end as item_type,
  cast(cast(l_quantity as int) as string) as units,
  cast(cast(l_quantity * 60 as decimal(20,6)) as string)
    as usage_time_for_underground_apps_seconds,
  {CURRENCY} as marketplace_currency,
  {TEXT_PRICE} as sales_price_marketplace_currency,
  cast(cast(l_extendedprice * 0.7 as decimal(20,6)) as string)
    as estimated_earnings_marketplace_currency,
  case when l_linenumber = 7 then null else cast(l_orderkey as string) end as receipt_id,
  'tv' as device_type, 'os' as device_os, {plain("raw_amazon")}, 'run1' as load_tx_id,
  concat('f_Amazon_', {SHIP_MONTH}) as file_tx_id
from {{lineitem}}
"""

VIEWS["raw_google"] = f"""
select concat('GPA.', cast(l_orderkey as string)) as order_number,
  substr(cast(l_shipdate as string), 1, 10) as order_charged_date,
  cast({AT} as string) as order_charged_timestamp,
  case when l_returnflag = 'R' then 'Refund' else 'Charged' end as financial_status,
  concat('p', cast(l_partkey as string)) as product_id, 'subscription' as product_type,
  {SKU} as sku_id, {pick("l_orderkey", ["US", "DE", "JP"])} as buyer_country,
  {CURRENCY} as buyer_currency, {TEXT_PRICE} as amount_buyer_currency,
  'USD' as currency_of_sale,
  cast(cast(l_extendedprice * 0.85 as decimal(20,6)) as string) as amount_merchant_currency,
  {plain("raw_google")}, 'run1' as load_tx_id, concat('f_Google_', {SHIP_MONTH}) as file_tx_id
from {{lineitem}}
"""

VIEWS["raw_roku"] = f"""
select concat('r', cast(l_orderkey as string)) as transaction_id,
  concat('ch', cast(l_suppkey as string)) as channel_id, {SKU} as product_id,
  'plan' as product_name, 'Subscription' as product_type,
  case when l_returnflag = 'R' then 'Refund' when l_returnflag = 'A' then 'UpgradeSale'
       else 'Purchase' end as transaction_type,
  cast({AT} as string) as transaction_date, {TEXT_PRICE} as amount, {CURRENCY} as currency,
  {pick("l_orderkey", ["US", "GB"])} as country_code, cast(l_suppkey as string) as user_id,
  {plain("raw_roku")}, 'run1' as load_tx_id, concat('f_Roku_', {SHIP_MONTH}) as file_tx_id
from {{lineitem}}
"""

VIEWS["raw_billing"] = f"""
select concat('t', cast(l_orderkey as string), '-', cast(l_linenumber as string))
    as transaction_id,
  cast(l_suppkey as string) as user_id,
  case when l_returnflag = 'R' then 'REFUND' else 'CHARGE' end as transaction_type,
  cast(cast(round(l_extendedprice * 100) as bigint) as string) as amount,
  {CURRENCY} as currency,
  cast(cast(round(l_extendedprice * l_tax * 100) as bigint) as string) as vat,
  cast(l_orderkey as string) as subscription_id,
  cast({AT} as string) as created_timestamp, cast({AT} as string) as charged_timestamp,
  {pick("l_orderkey", ["US", "GB"])} as payment_country,
  concat('v', cast(l_orderkey as string)) as vendor_reference_id,
  cast(cast(round(l_extendedprice * l_tax * 100) as bigint) as string) as vat_amount,
  case when l_linenumber = 7 then null
       else cast(cast(round(l_discount * 1000) as bigint) as string) end as sales_tax_amount,
  concat('i', cast(l_orderkey as string)) as invoice_id, 'Adyen' as payment_provider,
  'card' as payment_type, cast(l_shipdate as string) as invoice_generated_timestamp,
  'from_file' as realm, cast(l_linenumber as string) as installment_details_number_of_installments,
  cast({AT} as string) as updated_timestamp, {plain("raw_billing")}, 'run1' as load_tx_id, concat('f_Billing_', {SHIP_MONTH}) as file_tx_id
from {{lineitem}}
"""

BASE = "case currency_code when 'USD' then 1.0 when 'EUR' then 0.9 when 'GBP' then 0.8 " \
    "when 'JPY' then 110.0 else 0.3 end"
BASE_RATE = f"cast({BASE} as double) * ((100 + (day(day) % 10)) / cast(100 as double))"

# A rate per currency and day on which it trades. JPY is zero on day 28; day 13 has no rates.
VIEWS["exchange_rates"] = f"""
select currency_code, day as exchange_rate_date,
  case when currency_code = 'JPY' and day(day) = 28 then cast(0 as decimal(20,6))
       else cast({BASE_RATE} as decimal(20,6)) end as exchange_rate
from (
  select cast(l_shipdate as date) as day, {CURRENCY} as currency_code from {{lineitem}}
  union
  select cast(o_orderdate as date), {pick("o_orderkey", CURRENCIES)} from {{orders}}
) d
where day(day) <> 13
"""

# Quotes during the day, one per line sold.
VIEWS["rate_quotes"] = f"""
select currency_code, quoted_at,
  cast({BASE_RATE} * ((100 + n) / cast(100 as double)) as decimal(20,6)) as exchange_rate
from (
  select {CURRENCY} as currency_code, {AT} as quoted_at, cast(l_shipdate as date) as day,
    l_linenumber as n
  from {{lineitem}}
) q
"""

VIEWS["fallback_country"] = """
select * from (values ('USD', 'US'), ('EUR', 'DE'), ('GBP', 'GB'), ('JPY', 'JP'))
  as t(currency_code, country_code)
"""
VIEWS["vat"] = """
select country_code, cast(rate as decimal(10,4)) as vat_rate
from (values ('gb', 0.20), ('de', 0.19), ('jp', 0.10)) as t(country_code, rate)
"""
VIEWS["commission"] = """
select company, provider, area, cast(rate as decimal(10,4)) as commission_rate
from (values ('StreamCo', 'Amazon', 'All', 0.20), ('MaxStream', 'Amazon', 'All', 0.15),
  ('StreamCo', 'Google', '', 0.15)) as t(company, provider, area, rate)
"""
# The SKU reference the accrual uses, one row per channel, SKU and region ever sold.
VIEWS["accrual_skus"] = f"""
select payment_provider, sku_id, file_tx_region,
  case when sku_id like '%annual%' or sku_id like '%year%' or sku_id like '%12m%'
         or sku_id like '%.1y%' then 'YEAR'
       when sku_id like '%plain%' then 'OTHER' else 'MONTH' end as payment_period,
  case when sku_id like '%premium%' then 'premium' else 'ad_free' end as tier_type,
  case when sku_id like '%ppv%' or sku_id like '%golftv%' then 'N' else 'Y' end
    as included_in_accrual_yn,
  cast(0.25 as decimal(20,6)) as partner_revenue_share
from (
  select distinct {CHANNEL} as payment_provider, {SKU} as sku_id, {REGION} as file_tx_region
  from {{lineitem}}
) k
"""

REALM3 = pick("o_custkey", ["go", "dplay", "streaming"])
FILE_ID = f"concat('f_', {REALM3}, '_', substr(cast(o_orderdate as string), 1, 10))"
FILE_STATUS = """case when day(o_orderdate) % 5 <= 1 then 'LOADED_FACT'
  when day(o_orderdate) % 5 = 2 then 'SUPERSEDED'
  when day(o_orderdate) % 5 = 3 then 'IN_PROGRESS' end"""

# One sales file per realm and order day. Days below 4 come unpadded, and the first of a month as
# a file for the whole month.
VIEWS["collection_audit"] = f"""
select file_tx_id, concat('Amazon_', upper(realm)) as data_source,
  case when realm = 'streaming' and day(day) = 9 then 'PAYMENTS' else 'SALES' end
    as collection_type,
  case when day(day) = 1 then concat('amazon_', realm, '_sales_', substr(cast(day as string), 1, 7),
         '.csv')
       when day(day) < 4 then concat('amazon_', realm, '_sales_',
         substr(cast(day as string), 1, 8), cast(day(day) as string), '.csv')
       when day(day) = 30 then concat('amazon_', realm, '_full_', cast(day as string), '.csv')
       else concat('amazon_', realm, '_sales_', cast(day as string), '.csv') end as data_file,
  cast(day as timestamp) as data_file_timestamp,
  case when day(day) = 17 then null else n end as tx_row_count
from (
  select {FILE_ID} as file_tx_id, {REALM3} as realm, cast(o_orderdate as date) as day,
    count(*) as n
  from {{orders}} group by 1, 2, 3
) f
"""

VIEWS["load_audit"] = f"""
select file_tx_id, concat('Amazon_', upper(realm)) as data_source,
  case when day(day) = 1 then concat('amazon_', realm, '_sales_', substr(cast(day as string), 1, 7),
         '.csv')
       when day(day) < 4 then concat('amazon_', realm, '_sales_',
         substr(cast(day as string), 1, 8), cast(day(day) as string), '.csv')
       when day(day) = 30 then concat('amazon_', realm, '_full_', cast(day as string), '.csv')
       else concat('amazon_', realm, '_sales_', cast(day as string), '.csv') end as data_file,
  status, cast(null as bigint) as record_count_staging,
  cast(day as timestamp) as load_date_time
from (
  select distinct {FILE_ID} as file_tx_id, {REALM3} as realm, cast(o_orderdate as date) as day,
    {FILE_STATUS} as status
  from {{orders}}
) f
where status is not null
"""

# Events of the append-only audit: every order of a file writes one.
VIEWS["audit_log"] = f"""
select {FILE_ID} as file_tx_id, concat('Amazon_', upper({REALM3})) as data_source,
  'file.csv' as data_file,
  {pick("o_orderkey", ["IN_PROGRESS", "LOADED_FACT", "LOAD_ERROR"])} as status,
  o_custkey as record_count_staging, o_orderdate as load_date_time, o_orderkey as event_seq
from {{orders}}
"""

VIEWS["monitor_config"] = """
select * from (values
  ('amazon_sales', 'ENABLED', 'Amazon', 'SALES', 60),
  ('amazon_old', 'DISABLED', 'Amazon', 'SALES', 24))
  as t(mv_id, mv_status, data_source, collection_type, mv_range_in_months)
"""
# Layers: the second raw region holds one realm; urgent rows fail typing; only loaded files and
# some late ones reach the fact.
VIEWS["layer_raw"] = f"""
select {FILE_ID} as file_tx_id from {{orders}} where {REALM3} <> 'dplay'
"""
VIEWS["layer_raw_second"] = f"""
select {FILE_ID} as file_tx_id from {{orders}} where {REALM3} = 'dplay'
"""
VIEWS["layer_typed"] = f"""
select {FILE_ID} as file_tx_id from {{orders}} where o_orderpriority <> '1-URGENT'
"""
VIEWS["layer_fact"] = f"""
select {FILE_ID} as file_tx_id from {{orders}}
where o_orderpriority <> '1-URGENT'
  and ({FILE_STATUS} in ('LOADED_FACT', 'SUPERSEDED') or o_orderstatus = 'P')
"""

# Fact rows keyed by the files of load_audit, for supersession.
VIEWS["file_payments"] = f"""
select o_orderkey as payment_id, {FILE_ID} as file_tx_id, {REALM3} as realm,
  cast(o_totalprice as decimal(20,6)) as main_amount, o_orderdate as utc_timestamp
from {{orders}}
"""

# What a second delivery holds: dearer orders without the urgent ones, and some under new ids.
VIEWS["file_redelivered"] = f"""
select o_orderkey as payment_id, {FILE_ID} as file_tx_id, {REALM3} as realm,
  cast(o_totalprice + 1 as decimal(20,6)) as main_amount, o_orderdate as utc_timestamp
from {{orders}} where o_orderpriority <> '1-URGENT'
union all
select -o_orderkey, {FILE_ID}, {REALM3}, cast(o_totalprice as decimal(20,6)), o_orderdate
from {{orders}} where o_orderpriority = '2-HIGH'
"""

ACCOUNTS = ["StreamCoUS", "StreamCoEU", "Motortrend", "Foodnetwork", "HBOUS", "MaxStreamCOM"]
PRODUCTS = ["pgatour.month", "go.month", "go.annual", "max.month", "golf.month"]
ORDER_AT = "o_orderdate + interval '1' second * ((o_orderkey * 7919) % 86400)"
# One charge per order. Urgent ones share a reference per customer, so references repeat; some
# have none.
CHARGE_REFERENCE = """case when o_orderpriority = '1-URGENT' then
    concat('c', cast(o_custkey as string))
  when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then null
  else concat('r', cast(o_orderkey as string)) end"""

VIEWS["charges"] = f"""
select o_orderkey as charge_id, {pick("o_custkey", ACCOUNTS)} as merchant_account,
  case o_orderstatus when 'F' then 'RECURRING' when 'O' then 'REFUND' else 'CHARGEBACK' end
    as transaction_type,
  {CHARGE_REFERENCE} as psp_reference, {CHARGE_REFERENCE} as vendor_reference_id,
  case when o_orderpriority = '1-URGENT' then concat('m', cast(o_custkey as string))
       else concat('m', cast(o_orderkey as string)) end as merchant_reference,
  case when o_orderpriority = '1-URGENT' then concat('i', cast(o_custkey as string))
       else concat('i', cast(o_orderkey as string)) end as invoice_id,
  {pick("o_orderkey", PRODUCTS)} as product_id, o_custkey as subscription_id,
  cast(o_totalprice as decimal(20,6)) as amount, {pick("o_orderkey", CURRENCIES)} as currency,
  {ORDER_AT} as charged_timestamp
from {{orders}}
"""

# The provider's side: one payment per order, up to three days off; low-priority ones under a
# reference of their own, high-priority ones of another kind.
VIEWS["psp_payments"] = f"""
select o_orderkey + 1 as payment_id, {pick("o_custkey", ACCOUNTS)} as merchant_account,
  case when o_orderpriority = '2-HIGH' and o_orderstatus = 'F' then 'Settled'
       when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then 'Refunded'
       when o_orderstatus = 'F' then 'Authorised' when o_orderstatus = 'O' then 'SentForRefund'
       else 'Chargeback' end as record_type,
  case when o_orderpriority = '5-LOW' then concat('x', cast(o_orderkey as string))
       when o_orderpriority = '1-URGENT' and o_orderkey % 3 = 0 then ''
       when o_orderpriority = '1-URGENT' then concat('c', cast(o_custkey as string))
       else concat('r', cast(o_orderkey as string)) end as psp_reference,
  case when o_orderpriority = '1-URGENT' then concat('m', cast(o_custkey as string))
       when o_orderpriority = '3-MEDIUM' and o_custkey % 2 = 0 then null
       else concat('m', cast(o_orderkey as string)) end as merchant_reference,
  case when o_orderpriority = '1-URGENT' then concat('i', cast(o_custkey as string))
       else concat('i', cast(o_orderkey as string)) end as invoice_number,
  {pick("o_custkey", ["T0003", "T0006", "T1107", "T1201"])} as event_code,
  {pick("o_orderkey", PRODUCTS)} as product_id, o_custkey as subscription_id,
  cast(o_totalprice + case when o_orderpriority = '3-MEDIUM' then 1 else 0 end as decimal(20,6))
    as amount,
  {pick("o_orderkey", CURRENCIES)} as currency,
  {ORDER_AT} + interval '1' day * (case o_orderkey % 4 when 0 then -1 when 1 then 0
    when 2 then 1 else 3 end) as utc_timestamp
from {{orders}}
"""

VIEWS["provider_charges"] = f"""
select c.*, {pick("charge_id", ["Adyen", "PayPal", "Google", "Amazon"])} as payment_provider
from ({VIEWS["charges"]}) c
"""

# Few subscriptions, each with one reference, and few days: many equal rows compete for each other. Every
# seventh charge has no payment, every fifth payment comes two days late.
CROWDED_AT = "cast('1996-01-01 00:00:00' as timestamp) + interval '1' day * (o_custkey % 97)"
VIEWS["crowded_charges"] = f"""
select c.charge_id, c.merchant_account, c.transaction_type, c.psp_reference,
  concat('v', cast(o_orderkey % 23 as string)) as vendor_reference_id, c.merchant_reference,
  c.invoice_id, c.product_id, o_orderkey % 23 as subscription_id, c.amount, c.currency,
  {CROWDED_AT} + interval '1' second * (o_orderkey % 86400) as charged_timestamp
from ({VIEWS["charges"]}) c join {{orders}} on o_orderkey = charge_id
"""
VIEWS["crowded_payments"] = f"""
select p.payment_id, p.merchant_account, p.record_type,
  concat('v', cast(o_orderkey % 23 as string)) as psp_reference, p.merchant_reference,
  p.invoice_number, p.event_code, p.product_id, o_orderkey % 23 as subscription_id, p.amount,
  p.currency, {CROWDED_AT} + interval '1' second * ((o_orderkey * 31) % 86400)
    + interval '1' day * (case when o_custkey % 5 = 0 then 2 else o_orderkey % 3 - 1 end)
    as utc_timestamp
from ({VIEWS["psp_payments"]}) p join {{orders}} on o_orderkey + 1 = payment_id
where o_orderkey % 7 <> 0
"""

# Authorised when the customer's order is made, settled or refunded when lines ship.
VIEWS["delay_payments"] = f"""
select 'acct' as merchant_account, 'Authorised' as record_type,
  case when o_orderkey % 50 = 1 then '' else cast(o_orderkey as string) end as psp_reference,
  {ORDER_AT} as utc_timestamp
from {{orders}}
union all
select concat('acct', cast(l_suppkey % 4 as string)), case when l_returnflag = 'R' then 'Refunded'
    else 'Settled' end,
  case when l_orderkey % 50 = 2 then ' ' when l_orderkey % 50 = 1 then ''
    else cast(l_orderkey as string) end, {AT}
from {{lineitem}}
"""

PROVIDERS9 = [
    "Apple", "Google", "Amazon", "Roku", "Samsung", "Vizio", "Adyen", "PayPal", "Stripe",
]
REALMS8 = [
    "go", "dplay", "dplusapac", "bolt", "streaming", "eurosport", "motortrend", "other",
]
PLANS = ["p0", "p1", "p2", "p3", "p4", "p5", "p6"]

VIEWS["subscriptions"] = f"""
select o_orderkey as subscription_id, o_custkey as global_subscription_id,
  {pick("o_custkey", REALMS8)} as realm, {pick("o_custkey", ["amer", "emea", "latam"])}
    as source_region,
  {pick("o_orderkey", PROVIDERS9)} as payment_provider,
  case o_orderstatus when 'F' then 'TERMINATED' when 'O' then 'ACTIVE' else 'PAUSED' end as status,
  {pick("o_orderkey", PLANS)} as price_plan_id,
  o_orderdate as start_timestamp,
  case when o_orderstatus = 'F' then o_orderdate + interval '1' day * (o_custkey % 400) end
    as termination_timestamp,
  case o_custkey % 9 when 0 then 'SONY' when 1 then 'XBOX' when 2 then 'VIZIO' when 3 then 'LGE'
    when 4 then 'Samsung' end as affiliate,
  cast(o_orderdate as date) + cast(o_custkey % 40 as int) as next_due_date
from {{orders}}
"""

# Several rows per subscription: each order of a customer is a new state of it.
VIEWS["subscription_history"] = f"""
select o_orderkey as row_id, o_custkey as subscription_id,
  concat('g', cast(o_custkey % 500 as string)) as global_subscription_id,
  {pick("o_custkey", REALMS8)} as realm, {pick("o_custkey", ["amer", "emea", "latam"])}
    as source_region,
  {pick("o_custkey", PROVIDERS9)} as payment_provider,
  case o_orderstatus when 'F' then 'TERMINATED' when 'O' then 'ACTIVE' else 'PAUSED' end as status,
  o_orderdate as updated_timestamp
from {{orders}}
"""

VIEWS["price_plans"] = """
select price_plan_id, payment_period, currency, provider, cast(amount as decimal(20,6)) as amount
from (values ('p0', 'MONTH', 'USD', 'Adyen', 9.99), ('p1', 'YEAR', 'USD', 'Adyen', 99.99),
  ('p2', 'MONTH', 'RUB', 'Adyen', 499.0), ('p3', 'MONTH', 'EUR', 'PayPal', 8.99),
  ('p4', 'YEAR', 'EUR', 'PayPal', 89.99), ('p5', 'MONTH', 'GBP', 'Stripe', 7.99),
  ('p6', 'YEAR', 'RUB', 'Stripe', 4999.0))
  as t(price_plan_id, payment_period, currency, provider, amount)
"""
VIEWS["staged_price_plans"] = """
select * from (values ('p0', 'MONTH', 'Bolt'), ('p1', 'YEAR', 'Bolt'), ('p3', 'YEAR', 'Bolt'),
  ('p5', 'MONTH', 'Adyen')) as t(price_plan_id, payment_period, provider)
"""
# Charges of the subscriptions: some on the due day, some a day or more late.
VIEWS["billing_charges"] = """
select o_orderkey as subscription_id,
  case o_orderpriority when '1-URGENT' then 'FIRST' when '5-LOW' then 'REFUND'
    else 'RECURRING' end as transaction_type,
  o_orderdate + interval '1' day * ((o_custkey % 40) + (o_orderkey % 4)) as charged_timestamp
from {orders}
"""

VIEWS["affiliate_payments"] = f"""
select {pick("l_partkey", ["SONY", "XBOX", "VIZIO", "LGE", "Samsung"])} as affiliate,
  case l_returnflag when 'R' then 'UPGRADE' when 'A' then 'RECURRING' else 'FIRST' end
    as transaction_type,
  case l_linestatus when 'O' then 'MONTH' else 'YEAR' end as payment_period,
  {PRICE} as amount, l_shipdate as charged_timestamp,
  l_shipdate - interval '1' day * (l_suppkey * 31 % 500) as start_timestamp
from {{lineitem}}
"""
VIEWS["contracts"] = """
select affiliate, payment_cap_months, max_days_in_payment_cap,
  cast(share as decimal(20,10)) as revenue_share
from (values ('SONY', 12, 365, 0.15), ('XBOX', 6, 183, 0.20), ('VIZIO', 3, 91, 0.10),
  ('LGE', 12, 365, 0.125), ('Samsung', 9, 274, 0.3))
  as t(affiliate, payment_cap_months, max_days_in_payment_cap, share)
"""
VIEWS["settled_payments"] = f"""
select l_orderkey as subscription_id,
  case when l_returnflag = 'R' then 'Refunded' else 'Settled' end as record_type,
  {CURRENCY} as currency, {PRICE} as amount, l_shipdate as utc_timestamp
from {{lineitem}}
"""

# Lifecycle events; {{epoch}} is the engine's own way to get epoch seconds.
SNAPSHOTS = ["2023-12-31", "2024-01-03", "2024-01-10", "2024-01-17", "2024-01-24", "2024-01-31", "2024-03-31"]

VIEWS["lifecycle"] = f"""
select event_id, user_id as subscription_id, {{epoch}} as event_epoch,
  case event_type when 'signup' then (case when event_id % 2 = 0 then 'TRIAL' else 'ACQUIRE' end)
    when 'purchase' then 'RENEWAL' when 'click' then 'SWITCH' when 'view' then 'CANCEL'
    else 'PAYMENT' end as kind,
  {pick("event_id", ["basic", "standard", "premium", "family", "basic"])} as product_plan,
  cast(case event_id % 5 when 1 then 2 when 2 then 3 when 3 then 3 else 1 end as int)
    as plan_rank,
  {pick("event_id", ["svod", "avod"])} as vod_type, {pick("event_id", PLANS)} as price_plan,
  {pick("event_id", ["none", "spring", "bundle"])} as promo,
  cast(event_id % 28 + 1 as int) as billing_anchor,
  case event_id % 7 when 0 then 'HARD_DECLINE' when 1 then 'SOFT_DECLINE' when 2 then 'REFUND'
    when 3 then 'AUTO_RENEW_OFF' when 4 then 'CHARGEBACK' when 5 then 'MOVED' end as reason,
  case when value < 20 then 'SUCCESS' else 'FAILURE' end as attempt_result,
  cast(value as decimal(20,6)) as amount, {pick("event_id", CURRENCIES)} as currency,
  concat('inv', cast(user_id % 40 as string)) as invoice_id,
  {{epoch}} + (event_id % 11) * 3600 as term_end_epoch
from {{events}}
"""
EPOCH = {
    "spark": "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)",
    "duckdb": "date_diff('second', timestamp '1970-01-01', ts)",
}

VIEWS["case_states"] = """
select event_id as record_id,
  case event_type when 'error' then 'OPEN' when 'click' then 'IN_REVIEW'
    when 'view' then 'IN_REVIEW' else 'CLOSED' end as state,
  ts as state_timestamp
from {events}
"""

# Free text of the documents as a raw field: whole texts, cut only by the operator under test.
VIEWS["raw_text"] = """
select doc_id, text, case when doc_id % 3 = 0 then '  ' when doc_id % 3 = 1 then '' else source end
  as source
from {documents}
"""

_BASE = re.compile(r"\{(\w+)\}")


def view_sql(name: str, engine: str) -> str:
    """A view's SQL; for DuckDB with the plain table names filled in."""
    sql = VIEWS[name].replace("{epoch}", EPOCH[engine])
    if engine == "duckdb":
        sql = _BASE.sub(lambda m: m.group(1), sql)
    return sql


_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file; its schema is looked up once, as that lookup is a job of its own."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet files."""
    sql = view_sql(name, "spark").replace("as timestamp)", "as timestamp_ntz)")
    tables = {t: _table(spark, f"{sf_dir}/{t}.parquet") for t in set(_BASE.findall(sql))}
    return spark.sql(sql, **tables)


def with_views(names: list[str], body: str) -> str:
    """DuckDB SQL of a query over the named views."""
    parts = ", ".join(f"{n} as ({view_sql(n, 'duckdb')})" for n in names)
    return f"with {parts} {body}"
