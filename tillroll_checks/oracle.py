"""Plain SQL for every registered query, written from the meaning and not from the operators.

Windows, pair joins and long unions are fine here: this runs on one machine over small tables.
"""

from __future__ import annotations

from tillroll.sources.schemas import raw_widths
from tillroll_checks.inputs import PLAIN, SNAPSHOTS, with_views

ORACLE: dict[str, str] = {}

THREE = "('BHD','IQD','JOD','KWD','LYD','OMR','TND')"
ZERO = (
    "('BIF','CLP','CVE','DJF','GNF','ISK','JPY','KMF','KRW','PYG','RWF','UGX','VND','VUV','XAF',"
    "'XOF','XPF')"
)
CODE = "upper(trim(currency))"


def by_digits(three: str, zero: str, two: str) -> str:
    return f"case when {CODE} in {THREE} then {three} when {CODE} in {ZERO} then {zero} else {two} end"


def quotient(number: str, divisor: str, digits: int = 6, kind: str = "decimal(20,6)") -> str:
    """number / divisor rounded half up, in whole numbers; both have at most ten decimals."""
    n = f"(abs(cast({number} as decimal(28,10))) * 10000000000)::hugeint * {10 ** digits}"
    d = f"(cast({divisor} as decimal(28,10)) * 10000000000)::hugeint"
    unit = f"cast(0.{'0' * (digits - 1)}1 as decimal({digits + 1},{digits}))"
    whole = f"(2 * ({n}) + {d}) // (2 * {d})"
    return (
        f"case when {divisor} <> 0 then cast(sign({number})::int * cast({whole} as decimal(27,0)) "
        f"* {unit} as {kind}) end"
    )


MAJOR = (
    f"cast({by_digits('amount_minor * 0.001', 'amount_minor * 1.000', 'amount_minor * 0.010')} "
    "as decimal(20,6))"
)
EIGHTH = "cast(amount_minor * 0.125 as decimal(20,6))"


def rounded(value: str) -> str:
    return by_digits(
        f"cast(cast({value} as decimal(20,3)) as decimal(20,6))",
        f"cast(cast({value} as decimal(20,0)) as decimal(20,6))",
        f"cast(cast({value} as decimal(20,2)) as decimal(20,6))",
    )


def shown(value: str) -> str:
    return by_digits(
        f"cast(cast({value} as decimal(20,3)) as varchar)",
        f"cast(cast({value} as decimal(20,0)) as varchar)",
        f"cast(cast({value} as decimal(20,2)) as varchar)",
    )


def minor(name: str, columns: str) -> None:
    ORACLE[name] = with_views(["minor_amounts"], f"select *, {columns} from minor_amounts")


minor("minor_units", f"{MAJOR} as amount")
minor(
    "currency_exponents",
    f"{by_digits('3', '0', '2')} as exponent, {CODE} in {ZERO} as zero_decimal, "
    f"{CODE} in {THREE} as three_decimal",
)
minor("round_to_exponent", f"{rounded(EIGHTH)} as rounded")
minor("format_amount", f"{shown(MAJOR)} as shown")
minor("normalise_amounts", f"{rounded(MAJOR)} as amount_normalised")

ORACLE["raw_null_truncate"] = with_views(
    ["raw_text"],
    r"""select doc_id, case when regexp_matches(text, '\S') then left(text, 3000) end as text,
    case when regexp_matches(source, '\S') then source end as source from raw_text""",
)

# Typing
ORACLE["type_apple"] = with_views(
    ["raw_apple"],
    f"""select {', '.join(PLAIN['raw_apple'])}, sku, title, cast(units as int) as units,
    cast(developer_proceeds as decimal(20,6)) as developer_proceeds,
    cast(strptime(nullif(trim(begin_date), ''), '%m/%d/%Y') as date) as begin_date,
    cast(strptime(nullif(trim(end_date), ''), '%m/%d/%Y') as date) as end_date,
    customer_currency, cast(customer_price as decimal(20,6)) as customer_price, subscription,
    'AMER' as file_tx_region, load_tx_id, file_tx_id from raw_apple""",
)
LOCAL = "cast(substr(transaction_time, 1, 19) as timestamp)"
OFFSET = (
    "case substr(transaction_time, 21) when 'PST' then 8 when 'PDT' then 7 when 'EST' then 5 "
    "else 0 end"
)
AMAZON_TYPED = f"""select marketplace, country_region_code, invoice_id, transaction_id,
    {LOCAL} as transaction_time_local, substr(transaction_time, 21) as transaction_time_local_tz,
    {LOCAL} + interval '1' hour * ({OFFSET}) as transaction_time_utc,
    transaction_type, vendor_sku, title, item_name, item_type, cast(units as int) as units,
    cast(usage_time_for_underground_apps_seconds as decimal(20,6))
      as usage_time_for_underground_apps_seconds,
    marketplace_currency,
    cast(sales_price_marketplace_currency as decimal(20,6)) as sales_price_marketplace_currency,
    cast(estimated_earnings_marketplace_currency as decimal(20,6))
      as estimated_earnings_marketplace_currency,
    receipt_id, device_type, device_os, {', '.join(PLAIN['raw_amazon'])},
    'EMEA' as file_tx_region, load_tx_id, file_tx_id
    from raw_amazon"""
GOOGLE_TYPED = f"""select {', '.join(PLAIN['raw_google'])}, order_number, cast(order_charged_date as date) as order_charged_date,
    cast(order_charged_timestamp as timestamp) as order_charged_timestamp, financial_status,
    product_id, product_type, sku_id, buyer_country, buyer_currency,
    cast(amount_buyer_currency as decimal(20,6)) as amount_buyer_currency, currency_of_sale,
    cast(amount_merchant_currency as decimal(20,6)) as amount_merchant_currency,
    'APAC' as file_tx_region, load_tx_id, file_tx_id from raw_google"""
ROKU_TYPED = f"""select {', '.join(PLAIN['raw_roku'])}, transaction_id, channel_id, product_id, product_name, product_type,
    transaction_type, cast(transaction_date as timestamp) as transaction_date,
    cast(amount as decimal(20,6)) as amount, currency, country_code, user_id,
    'AMER' as file_tx_region, load_tx_id, file_tx_id from raw_roku"""


def major(column: str) -> str:
    value = f"cast({column} as bigint)"
    return (
        f"cast({by_digits(f'{value} * 0.001', f'{value} * 1.000', f'{value} * 0.010')} "
        f"as decimal(20,6)) as {column}"
    )


BILLING_TYPED = f"""select {', '.join(PLAIN['raw_billing'])},
    cast(updated_timestamp as timestamp) as updated_timestamp, transaction_id, user_id, transaction_type, {major('amount')}, currency,
    {major('vat')}, cast(subscription_id as int) as subscription_id,
    cast(created_timestamp as timestamp) as created_timestamp,
    cast(charged_timestamp as timestamp) as charged_timestamp, payment_country,
    vendor_reference_id, {major('vat_amount')}, {major('sales_tax_amount')}, invoice_id,
    payment_provider, payment_type, invoice_generated_timestamp, 'direct_billing' as realm,
    cast(installment_details_number_of_installments as int)
      as installment_details_number_of_installments, load_tx_id, file_tx_id from raw_billing"""
ORACLE["type_amazon"] = with_views(["raw_amazon"], AMAZON_TYPED)
ORACLE["type_google"] = with_views(["raw_google"], GOOGLE_TYPED)
ORACLE["type_roku"] = with_views(["raw_roku"], ROKU_TYPED)
ORACLE["type_billing"] = with_views(["raw_billing"], BILLING_TYPED)
ORACLE["staged_counts"] = with_views(
    ["raw_amazon"],
    "select file_tx_id, count(*) as record_count_staging from raw_amazon group by 1",
)

FACT_NULLS = dict.fromkeys(
    [
        "company_account", "merchant_account", "payment_currency", "net", "name",
        "invoice_number", "receipt_id", "transaction_id", "vendor_sku", "hardware", "product_id",
        "product_title", "file_tx_region", "adjustment", "asin", "in_app_subscription_term",
        "in_app_subscription_status", "digital_order_id", "app_user_id", "sales_channel",
    ],
    "cast(null as varchar)",
)
FACT_NULLS["net"] = "cast(null as decimal(20,6))"


def fact(name: str, raw: str, typed: str, columns: dict[str, str]) -> None:
    key = columns.get("receipt_id", columns["psp_reference"])
    values = {
        **FACT_NULLS,
        "vat": "cast(0 as decimal(20,6))",
        "pmt_ra_status": "0",
        "fact_etl_revision": "'1.0.0'",
        "load_tx_id": "load_tx_id",
        "file_tx_id": "file_tx_id",
        "timezone": "'UTC'",
        "local_timestamp": columns["utc_timestamp"],
        "utc_date": f"cast({columns['utc_timestamp']} as date)",
        "record_key": f"coalesce({key}, '') || '~' || cast({columns['utc_timestamp']} as varchar) "
        f"|| '~' || {columns['record_type']} || '~'",
        **columns,
    }
    listed = ", ".join(f"{v} as {k}" for k, v in values.items())
    ORACLE[name] = with_views([raw], f", typed as ({typed}) select {listed} from typed")


fact(
    "fact_amazon",
    "raw_amazon",
    AMAZON_TYPED,
    {
        "company_account": "title", "merchant_account": "marketplace",
        "psp_reference": "coalesce(receipt_id, '')", "local_timestamp": "transaction_time_local",
        "timezone": "transaction_time_local_tz", "utc_timestamp": "transaction_time_utc",
        "main_currency": "marketplace_currency",
        "main_amount": "sales_price_marketplace_currency",
        "payment_currency": "marketplace_currency",
        "net": "estimated_earnings_marketplace_currency", "record_type": "transaction_type",
        "name": "item_name", "type": "item_type", "invoice_number": "invoice_id",
        "receipt_id": "receipt_id", "issuer_country": "country_region_code",
        "pmt_channel": "'Amazon'", "pmt_channel_nr": "3", "transaction_id": "transaction_id",
        "vendor_sku": "vendor_sku", "hardware": "device_type", "product_title": "device_os",
        **{name: name for name in PLAIN["raw_amazon"]},
        "file_tx_region": "file_tx_region",
    },
)
fact(
    "fact_google",
    "raw_google",
    GOOGLE_TYPED,
    {
        "psp_reference": "order_number", "utc_timestamp": "order_charged_timestamp",
        "main_currency": "buyer_currency", "main_amount": "amount_buyer_currency",
        "payment_currency": "currency_of_sale", "net": "amount_merchant_currency",
        "record_type": "financial_status", "type": "product_type",
        "issuer_country": "buyer_country", "pmt_channel": "'Google'", "pmt_channel_nr": "2",
        "vendor_sku": "sku_id", "product_id": "product_id", "file_tx_region": "file_tx_region",
        "hardware": "hardware", "product_title": "product_title",
    },
)
fact(
    "fact_roku",
    "raw_roku",
    ROKU_TYPED,
    {
        "psp_reference": "transaction_id", "utc_timestamp": "transaction_date",
        "main_currency": "currency", "main_amount": "amount", "payment_currency": "currency",
        "record_type": "transaction_type", "name": "product_name", "type": "product_type",
        "issuer_country": "country_code", "pmt_channel": "'Roku'", "pmt_channel_nr": "4",
        "transaction_id": "transaction_id", "vendor_sku": "product_id", "product_id": "product_id",
        "app_user_id": "user_id", "file_tx_region": "file_tx_region",
    },
)
fact(
    "fact_billing",
    "raw_billing",
    BILLING_TYPED,
    {
        "merchant_account": "payment_provider", "psp_reference": "vendor_reference_id",
        "utc_timestamp": "charged_timestamp", "main_currency": "currency", "main_amount": "amount",
        "payment_currency": "currency", "vat": "vat_amount", "record_type": "transaction_type",
        "type": "payment_type", "invoice_number": "invoice_id",
        "issuer_country": "payment_country", "pmt_channel": "'DirectBilling'",
        "pmt_channel_nr": "5", "transaction_id": "transaction_id", "name": "product_name",
        "app_user_id": "user_id",
    },
)

# Files
ORACLE["audit_current"] = with_views(
    ["audit_log"],
    """select * exclude (event_seq, n) from (
      select *, row_number() over (partition by file_tx_id
        order by load_date_time desc, event_seq desc) as n from audit_log) where n = 1""",
)
ORACLE["audit_staged_counts"] = with_views(
    ["load_audit", "layer_typed"],
    """select a.* replace ((select nullif(count(*), 0) from layer_typed t
      where t.file_tx_id = a.file_tx_id) as record_count_staging) from load_audit a""",
)
MTD = """, mtd as (
  select file_tx_id, status, split_part(data_file, '_', 2) || split_part(data_file, '_', 3)
      || split_part(d, '-', 1) || split_part(d, '-', 2) as realm_month_key,
    split_part(d, '-', 3) as day_of_month
  from (select *, split_part(split_part(data_file, '_', 4), '.', 1) as d from load_audit)
  where data_source ilike 'Amazon_%' and lower(data_file) like '%sales%'
), gone as (
  select distinct o.file_tx_id, o.realm_month_key, o.day_of_month from mtd o join mtd i
    on o.realm_month_key = i.realm_month_key and i.status in ('LOADED_FACT', 'SUPERSEDED')
  where (length(o.day_of_month) = length(i.day_of_month) and o.day_of_month < i.day_of_month)
    or length(o.day_of_month) < length(i.day_of_month)
)"""
ORACLE["mtd_superseded"] = with_views(["load_audit"], MTD + " select * from gone")
ORACLE["mtd_superseded_by_file"] = with_views(
    ["load_audit"],
    MTD
    + """ select o.file_tx_id from mtd o join mtd i on o.realm_month_key = i.realm_month_key
    where i.file_tx_id = 'f_dplay_1995-02-18' and ((length(o.day_of_month) = length(i.day_of_month)
      and o.day_of_month < i.day_of_month) or length(o.day_of_month) < length(i.day_of_month))""",
)
ORACLE["audit_after_supersession"] = with_views(
    ["load_audit"],
    MTD
    + """ select * replace (case when file_tx_id in (select file_tx_id from gone)
    then 'SUPERSEDED' else status end as status) from load_audit""",
)
ORACLE["fact_after_supersession"] = with_views(
    ["load_audit", "file_payments"],
    MTD + """ select * from file_payments
    where file_tx_id not in (select file_tx_id from gone)""",
)
ORACLE["reload_idempotent"] = with_views(
    ["file_payments", "file_redelivered"],
    """select * from file_payments where file_tx_id <> 'f_dplay_1995-11-04'
    union all select * from file_redelivered where file_tx_id = 'f_dplay_1995-11-04'""",
)


# SKUs
def realm_case(sku: str, prefixes_dplay: str, prefixes_go: str) -> str:
    return f"""case file_tx_region when 'AMER' then 'go' when 'EMEA' then 'dplay'
    when 'APAC' then 'streaming_apac' when 'MAX' then 'streaming' when 'MAXTR' then 'streaming'
    when 'CNN' then 'streaming' when 'ESP' then 'eurosport' when 'MT' then 'motortrend'
    when 'INDIA' then 'streaming_india'
    when 'DPLUS' then case when {prefixes_go} then 'go' when {prefixes_dplay} then 'dplay'
      else 'go' end end"""


def any_like(sku: str, *patterns: str) -> str:
    return "(" + " or ".join(f"{sku} ilike '{p}'" for p in patterns) + ")"


def sku_select(
    channel: str, sku: str, apple: bool, included: str, first_seen: str, source: str
) -> str:
    go = ["br_%", "ca_%", "us_%"] + ([] if apple else ["dplus_%"])
    dplay = ["de.%", "uk_%"] + ([] if apple else ["ie_%"])
    years = ["%annual%", "%.year%", "%12month%"] + ([] if apple else ["%.1y%", "%12m.%"])
    lite = ["%avod%", "%lite%"] + ([] if apple else ["%light%"])
    maxtr = "" if apple else "when file_tx_region = 'MAXTR' then 'emea'"
    return f"""select {channel} as payment_provider,
    {realm_case(sku, any_like(sku, *dplay), any_like(sku, *go))} as realm,
    case when file_tx_region = 'MAX' and {any_like(sku, '%.us%', 'stream.%')} then 'amer'
      when file_tx_region = 'MAX' and {any_like(sku, '%latam%', '%.lat.%')} then 'latam' {maxtr}
      when file_tx_region = 'MAX' and {sku} ilike '%emea%' then 'emea'
      when file_tx_region = 'MAX' and {sku} ilike '%apac%' then 'apac'
      when file_tx_region = 'MAX' then 'amer' when file_tx_region = 'CNN' then 'cnn' end
      as source_region,
    file_tx_region, {sku} as sku_id,
    case when {any_like(sku, *years)} then 'YEAR' else 'MONTH' end as payment_period,
    case when {sku} ilike '%premium%' then 'premium' when {sku} ilike '%svod%' then 'ad_free'
      when {any_like(sku, *lite)} then 'ad_lite' else 'ad_free' end as tier_type,
    case when {included} then 'Y' else 'N' end as included_in_accrual_yn,
    cast(0 as decimal(20,6)) as partner_revenue_share,
    cast({first_seen} as timestamp) as sku_create_timestamp, 'Y' as auto_generated_yn
    from {source}"""


SKU_REGIONS = "('AMER','MAX','DPLUS','EMEA','ESP','CNN','MAXTR','INDIA')"


def never(sku: str) -> str:
    return any_like(sku, "%.foodnetwork.%", "%golftv%", "%ppv%")


def unknown(channel: str, sku: str) -> str:
    return f"""not exists (select 1 from known_skus k where k.sku_id = p.{sku}
      and k.payment_provider = {channel} and k.file_tx_region = p.file_tx_region)"""


ORACLE["sku_classify"] = with_views(
    ["payments", "apple_sales", "known_skus"],
    sku_select(
        "pmt_channel",
        "vendor_sku",
        False,
        f"file_tx_region in {SKU_REGIONS} and not {never('vendor_sku')} and sum(main_amount) <> 0",
        "min(utc_timestamp)",
        f"""payments p where {unknown('p.pmt_channel', 'vendor_sku')} and (
          (pmt_channel = 'Amazon' and record_type = 'Charge' and type = 'Subscription')
          or (pmt_channel = 'Google' and record_type = 'Charged' and lower(type) = 'subscription')
          or (pmt_channel = 'Roku' and record_type in ('Purchase', 'UpgradeSale')))
        group by pmt_channel, vendor_sku, file_tx_region""",
    )
    + " union all "
    + sku_select(
        "'Apple'",
        "sku",
        True,
        f"file_tx_region <> 'APAC' and not {never('sku')} "
        "and sum(abs(customer_price) * units) <> 0",
        "min(end_date)",
        f"""apple_sales p where {unknown("'Apple'", 'sku')}
          and subscription in ('Renewal', 'New') group by sku, file_tx_region""",
    ),
)
ORACLE["sku_promote"] = with_views(
    ["payments", "apple_sales", "known_skus"],
    f""", revenue as (
      select 'Apple' as channel, sku, file_tx_region, sum(abs(customer_price) * units) as total
      from apple_sales where subscription in ('Renewal', 'New') group by 1, 2, 3
      union all
      select pmt_channel, vendor_sku, file_tx_region, sum(abs(main_amount)) from payments
      where pmt_channel in ('Amazon', 'Google', 'Roku') group by 1, 2, 3)
    select k.* replace (case when k.auto_generated_yn = 'Y' and r.total > 0
        and k.file_tx_region in {SKU_REGIONS} and not {never('k.sku_id')} then 'Y'
      else k.included_in_accrual_yn end as included_in_accrual_yn)
    from known_skus k left join revenue r on r.channel = k.payment_provider
      and r.sku = k.sku_id and r.file_tx_region = k.file_tx_region""",
)
ORACLE["new_sku_alert"] = with_views(
    ["payments", "known_skus"],
    f"""select pmt_channel as payment_provider, vendor_sku as sku_id, file_tx_region,
      count(*) as rows, min(utc_timestamp) as first_seen, max(utc_timestamp) as last_seen
    from payments p where {unknown('p.pmt_channel', 'vendor_sku')} group by 1, 2, 3""",
)

# Accrual
ACCRUAL_VIEWS = [
    "payments", "accrual_skus", "exchange_rates", "fallback_country", "vat", "commission",
]


def accrual(channels: str) -> str:
    rate = "x.exchange_rate"
    return f""", base as (
      select p.*, s.payment_period, s.tier_type, s.partner_revenue_share,
        cast(p.utc_timestamp as date) as day,
        case p.file_tx_region when 'AMER' then 'go' when 'EMEA' then 'dplay'
          when 'MAX' then 'streaming' when 'ESP' then 'eurosport' else '' end as realm,
        case p.file_tx_region when 'MAX' then 'max' when 'AMER' then 'amer' when 'EMEA' then 'emea'
          end as source_region,
        case when p.file_tx_region in ('AMER', 'EMEA', 'ESP') then 'StreamCo' else 'MaxStream' end
          as company,
        case when trim(coalesce(issuer_country, '')) in ('', '**') then lower(f.country_code)
          else lower(issuer_country) end as country_code
      from payments p
      join accrual_skus s on s.sku_id = p.vendor_sku and s.file_tx_region = p.file_tx_region
        and s.payment_provider = p.pmt_channel and s.included_in_accrual_yn = 'Y'
        and s.payment_period in ('MONTH', 'YEAR')
      left join fallback_country f on f.currency_code = p.main_currency
      where utc_timestamp >= timestamp '1999-12-01' and utc_timestamp < timestamp '2001-12-01'
        and p.file_tx_region in ('AMER', 'EMEA', 'MAX', 'ESP', 'CNN') and ({channels})
    ), joined as (
      select b.*, coalesce(v.vat_rate, 0) as vat, m.commission_rate, x.exchange_rate,
        r.currency_code as reporting_currency, r.exchange_rate as reporting_rate,
        case payment_period when 'MONTH' then date_diff('day', date_trunc('month', day),
            date_trunc('month', day) + interval '1' month)
          else date_diff('day', day, day + interval '1' year) end as days_in_period
      from base b
      left join vat v on v.country_code = b.country_code
      left join commission m on m.company = b.company and m.provider = b.pmt_channel
        and m.area = case when b.pmt_channel = 'Amazon' then 'All' else '' end
      left join exchange_rates x on x.currency_code = b.main_currency
        and x.exchange_rate_date = b.day
      left join exchange_rates r on r.exchange_rate_date = b.day and r.currency_code =
        case realm when 'eurosport' then 'EUR' when 'dplay' then 'GBP' when 'go' then 'USD'
          when 'streaming' then 'USD' else main_currency end
    ), vatted as (
      select *, cast(main_amount - {quotient('main_amount', '(1 + vat)')} as decimal(20,6))
        as vat_amount from joined
    ), earned as (
      select *, cast(main_amount - vat_amount as decimal(20,6)) as revenue from vatted
    ), rows as (
      select *, cast(revenue * commission_rate as decimal(20,6)) as commission from earned
    ), accrued as (
      select pmt_channel as payment_provider, psp_reference, payment_period,
        vendor_sku as product_name, tier_type, net, main_amount,
        cast(0 as decimal(20,6)) as sales_tax, main_amount as amount, main_currency as currency,
        case when exchange_rate = 0 then cast(0 as decimal(20,10))
          when main_currency = 'USD' then cast(1 as decimal(20,10))
          else {quotient('1', 'exchange_rate', 10, 'decimal(20,10)')} end
          as exchange_rate_to_usd,
        reporting_currency,
        case when exchange_rate = 0 then cast(0 as decimal(20,10))
          else {quotient('reporting_rate', 'exchange_rate', 10, 'decimal(20,10)')} end
          as reporting_currency_exchange_rate,
        issuer_country as subscribed_in_country, country_code, record_type as transaction_type,
        realm, file_tx_region, source_region, company, utc_timestamp as created_timestamp,
        cast(vat as decimal(10,4)) as vat_rate, vat_amount, revenue, commission_rate, commission,
        cast(days_in_period as int) as days_in_period,
        {quotient('revenue', 'days_in_period')} as daily_revenue_rate,
        {quotient('commission', 'days_in_period')} as daily_commission_rate,
        case when realm = 'eurosport' and country_code not in
          ('gb', 'uk', 'gg', 'gi', 'ie', 'im', 'je') then cast(0 as decimal(20,6))
          else partner_revenue_share end as partner_rev_share
      from rows
    )"""


ONLY_AMAZON = "pmt_channel = 'Amazon' and record_type = 'Charge' and type = 'Subscription'"
ALL_CHANNELS = f"""({ONLY_AMAZON})
  or (pmt_channel = 'Google' and record_type = 'Charged' and lower(type) = 'subscription')
  or (pmt_channel = 'Roku' and record_type in ('Purchase', 'UpgradeSale'))"""
DAILY = """ select payment_provider, realm, payment_period,
  cast(created_timestamp as date) as charge_date, count(*) as charges,
  cast(sum(revenue) as decimal(38,6)) as revenue,
  cast(sum(daily_revenue_rate) as decimal(38,6)) as daily_revenue_rate,
  cast(sum(daily_commission_rate) as decimal(38,6)) as daily_commission_rate
  from accrued group by 1, 2, 3, 4"""
ORACLE["accrual_rows"] = with_views(ACCRUAL_VIEWS, accrual(ONLY_AMAZON) + " select * from accrued")
ORACLE["accrual_daily"] = with_views(ACCRUAL_VIEWS, accrual(ONLY_AMAZON) + DAILY)
ORACLE["accrual_all_channels"] = with_views(ACCRUAL_VIEWS, accrual(ALL_CHANNELS) + DAILY)
ORACLE["fx_daily_avg"] = with_views(
    ["rate_quotes"],
    f"""select currency_code, day as exchange_rate_date,
      {quotient('total', 'n')} as exchange_rate
    from (select currency_code, cast(quoted_at as date) as day,
      cast(sum(exchange_rate) as decimal(28,6)) as total, count(*) as n
      from rate_quotes group by 1, 2)""",
)

DISCOVERY = (
    "('go','dplay','dplusapac','eurosport','motortrend','streaming_apac','streaming_india')"
)
for _name, _test in {
    "all": "true",
    "discovery": f"realm in {DISCOVERY}",
    "max": "realm in ('bolt', 'streaming')",
    "one": "realm = 'dplay'",
}.items():
    ORACLE[f"realm_filter_{_name}"] = with_views(
        ["subscriptions"],
        f"select realm, count(*) as subscriptions from subscriptions where {_test} group by 1",
    )

# Monitoring: seven layers, one below the other
SIX = "data_source, collection_type, file_date, data_file, file_tx_id, load_status"
MONITOR_VIEWS = [
    "collection_audit", "load_audit", "monitor_config", "layer_raw", "layer_raw_second",
    "layer_typed", "layer_fact",
]
RATIOS = """
  cast(case when fact_recorded_file_count <> files_collected then 0
    else final_transaction_count - fact_transaction_count end as bigint) as overwritten,
  case when records_audit_trail = 0 then 0
    else cast(round(cast(fact_transaction_count * 100 as double) / records_audit_trail, 4)
      as double) end as pct_fact,
  case when records_audit_trail = 0 then 0
    else cast(round(cast(fact_recorded_transaction_count * 100 as double) / records_audit_trail, 4)
      as double) end as variance"""
COUNTS = [
    "files_collected", "records_audit_trail", "raw_file_count", "raw_transaction_count",
    "final_file_count", "final_transaction_count", "fact_file_count", "fact_transaction_count",
    "fact_recorded_file_count", "fact_recorded_transaction_count",
]
SUMS = ", ".join(f"cast(sum(c{i}) as bigint) as {n}" for i, n in enumerate(COUNTS))


def layer(values: dict[int, str], rest: str) -> str:
    columns = ", ".join(f"{values.get(i, '0')} as c{i}" for i in range(10))
    return f"select {', '.join('c.' + x for x in SIX.split(', '))}, {columns} from files c {rest}"


GROUP = "group by " + ", ".join("c." + x for x in SIX.split(", "))
DONE = "('LOADED_FACT_IGNORED', 'SUPERSEDED')"
MONITOR = f""", files as (
  select c.file_tx_id, c.data_source, c.collection_type, c.data_file,
    cast(c.data_file_timestamp as date) as file_date, c.tx_row_count, l.status as load_status
  from collection_audit c
  join monitor_config g on g.mv_id = 'amazon_sales' and g.mv_status = 'ENABLED'
    and split_part(c.data_source, '_', 1) = g.data_source
    and c.collection_type = g.collection_type and c.data_file not like '%full%'
    and c.data_file_timestamp >= date '2001-06-15' - to_months(g.mv_range_in_months)
    and c.data_file_timestamp <= date '2001-06-15'
  left join load_audit l on l.file_tx_id = c.file_tx_id
), layers as (
  {layer({0: 'count(distinct c.file_tx_id)', 1: 'sum(c.tx_row_count)'}, GROUP)}
  union all
  {layer({2: 'count(distinct r.file_tx_id)', 3: 'sum(r.n)'},
         '''join (select file_tx_id, count(*) as n from layer_raw group by 1
           union all select file_tx_id, count(*) from layer_raw_second group by 1) r
           on r.file_tx_id = c.file_tx_id ''' + GROUP)}
  union all
  {layer({4: 'count(distinct t.file_tx_id)', 5: 'count(*)'},
         'join layer_typed t on t.file_tx_id = c.file_tx_id ' + GROUP)}
  union all
  {layer({6: 'count(distinct f.file_tx_id)', 7: 'count(*)'},
         'join layer_fact f on f.file_tx_id = c.file_tx_id ' + GROUP)}
  union all
  {layer({8: 'count(distinct f.file_tx_id)', 9: 'count(*)'},
         f'join layer_fact f on f.file_tx_id = c.file_tx_id where c.load_status not in {DONE} '
         + GROUP)}
  union all
  {layer({8: 'count(distinct c.file_tx_id)', 9: 'sum(c.tx_row_count)'},
         f'where c.load_status in {DONE} ' + GROUP)}
  union all
  {layer({8: 'count(distinct c.file_tx_id)', 9: 'sum(c.tx_row_count)'},
         f'''where (c.load_status not in ('LOADED_FACT', 'LOADED_FACT_IGNORED', 'SUPERSEDED')
             or c.load_status is null)
           and exists (select 1 from files o where o.data_source = c.data_source
             and o.collection_type = c.collection_type and o.load_status = 'LOADED_FACT'
             and date_trunc('month', o.file_date) = date_trunc('month', c.file_date)
             and c.file_date < o.file_date) ''' + GROUP)}
), counted as (select {SIX}, {SUMS} from layers group by {SIX}),
monitored as (select *, {RATIOS} from counted)"""
ORACLE["monitor_files"] = with_views(MONITOR_VIEWS, MONITOR + " select * from monitored")
ORACLE["monitor_master"] = with_views(
    MONITOR_VIEWS, MONITOR + " select 'amazon_sales' as mv_id, * from monitored"
)
ORACLE["monitor_daily"] = with_views(
    MONITOR_VIEWS,
    MONITOR
    + f""", daily as (select data_source, collection_type, file_date,
      {', '.join(f'cast(sum({n}) as bigint) as {n}' for n in COUNTS)}
      from counted group by 1, 2, 3) select *, {RATIOS} from daily""",
)
ORACLE["monitor_master_stats"] = with_views(
    MONITOR_VIEWS,
    MONITOR
    + """ select 'amazon_sales' as mv_id, min(file_date) as mv_min_date,
      max(file_date) as mv_max_date, count(*) as mv_row_count from monitored
      having count(*) > 0""",
)


# Reconciliation
def blank(column: str) -> str:
    return f"nullif(trim({column}), '')"


def matched(
    payment_keys: list[str],
    charge_keys: list[str],
    payment_test: str,
    charge_test: str,
    charge_type: str,
    charge_reference: str,
) -> str:
    names = [f"k{i}" for i in range(len(payment_keys))]
    whole = " and ".join(f"{n} is not null" for n in names)

    def side(view: str, keys: list[str], test: str, at: str, ident: str) -> str:
        listed = ", ".join(f"{k} as {n}" for k, n in zip(keys, names))
        return f"""select *, case when {whole} then row_number() over (
            partition by {', '.join(names)} order by {at}, {ident}) end as nr
          from (select *, {listed} from {view} where {test})"""

    on = " and ".join(f"p.{n} = c.{n}" for n in [*names, "nr"])

    def either(payment: str, charge: str) -> str:
        return f"case when p.payment_id is not null then p.{payment} else c.{charge} end"

    return f""", p as ({side('psp_payments', payment_keys, payment_test, 'utc_timestamp',
                              'payment_id')}),
    c as (select *, {charge_type} as kind from
      ({side('charges', charge_keys, charge_test, 'charged_timestamp', 'charge_id')})),
    detail as (select cast(coalesce(p.utc_timestamp, c.charged_timestamp) as date) as recon_date,
      case when c.charge_id is null then 'PAYMENT_ONLY' when p.payment_id is null
        then 'CHARGE_ONLY' else 'MATCHED' end as state,
      p.payment_id, c.charge_id, {either('psp_reference', charge_reference)} as psp_reference,
      {either('merchant_account', 'merchant_account')} as merchant_account,
      {either('record_type', 'kind')} as record_type,
      {either('product_id', 'product_id')} as product_id,
      p.amount as payment_amount, c.amount as charge_amount
    from p full join c on {on})"""


KIND = (
    "case transaction_type when 'RECURRING' then 'Authorised' when 'REFUND' then 'SentForRefund' "
    "else 'Chargeback' end"
)


def adyen_merchant(kind: str) -> str:
    return f"""case when {kind} = 'Chargeback' or ({kind} = 'SentForRefund'
      and merchant_account in ('Motortrend', 'Foodnetwork')) then ''
      else {blank('merchant_reference')} end"""


def paypal(invoice: str) -> list[str]:
    return [
        "merchant_account = 'HBOUS'",
        blank("psp_reference"),
        f"case when merchant_account = 'HBOUS' then '' else {blank(invoice)} end",
    ]


DETAILS = {
    "adyen": matched(
        ["record_type", blank("psp_reference"), adyen_merchant("record_type")],
        [KIND, blank("psp_reference"), adyen_merchant(KIND)],
        "record_type in ('Authorised', 'SentForRefund', 'Chargeback')",
        "true",
        KIND,
        "psp_reference",
    ),
    "paypal": matched(
        paypal("invoice_number"),
        paypal("invoice_id"),
        "event_code in ('T0003', 'T0006', 'T1107')",
        "true",
        "transaction_type",
        "psp_reference",
    ),
    "google": matched(
        [blank("psp_reference")],
        [blank("vendor_reference_id")],
        "product_id not like '%pgatour%'",
        "product_id not like '%pgatour%'",
        "transaction_type",
        "vendor_reference_id",
    ),
    # Two pointers a key: the earliest open payment and charge pair if their days are close enough, else the
    # earlier of the two is passed over.
    "amazon": """, ap as (select payment_id, cast(utc_timestamp as date) as day, subscription_id as s,
        psp_reference as r, row_number() over (partition by subscription_id, psp_reference
          order by utc_timestamp, payment_id) as nr
      from psp_payments where trim(psp_reference) <> '' and subscription_id is not null),
    ac as (select charge_id, cast(charged_timestamp as date) as day, subscription_id as s,
        vendor_reference_id as r, row_number() over (partition by subscription_id, vendor_reference_id
          order by charged_timestamp, charge_id) as nr
      from charges where trim(vendor_reference_id) <> '' and subscription_id is not null),
    walk as (select s, r, cast(1 as bigint) as i, cast(1 as bigint) as j, cast(null as bigint) as payment_id,
        cast(null as bigint) as charge_id from (select distinct s, r from ap) semi join ac using (s, r)
      union all select w.s, w.r,
        w.i + case when ac.day < ap.day - 1 then 0 else 1 end,
        w.j + case when ap.day < ac.day - 1 then 0 else 1 end,
        case when abs(date_diff('day', ap.day, ac.day)) <= 1 then ap.payment_id end,
        case when abs(date_diff('day', ap.day, ac.day)) <= 1 then ac.charge_id end
      from walk w join ap on ap.s = w.s and ap.r = w.r and ap.nr = w.i
        join ac on ac.s = w.s and ac.r = w.r and ac.nr = w.j),
    answer as (select payment_id, charge_id from walk where payment_id is not null),
    detail as (select cast(utc_timestamp as date) as recon_date,
      case when a.charge_id is not null then 'MATCHED' else 'PAYMENT_ONLY' end as state,
      p.payment_id, a.charge_id, p.subscription_id, p.psp_reference,
      p.merchant_account, p.record_type, p.product_id, p.amount as payment_amount,
      c.amount as charge_amount
      from psp_payments p left join answer a on a.payment_id = p.payment_id
        left join charges c on c.charge_id = a.charge_id
    union all select cast(charged_timestamp as date), 'CHARGE_ONLY', null, charge_id,
      subscription_id, vendor_reference_id, merchant_account, transaction_type, product_id, null,
      amount from charges where charge_id not in (select charge_id from answer))""",
}
PROVIDERS = {"adyen": "Adyen", "paypal": "PayPal", "google": "Google", "amazon": "Amazon"}
LEVELS = """ select cast(case when grouping(recon_date) = 1 then 0 when grouping(product_id) = 1
    then 1 else 2 end as int) as level, recon_date, merchant_account, record_type, product_id,
  count(*) filter (state = 'MATCHED') as matched,
  count(*) filter (state <> 'MATCHED') as unmatched,
  round(cast(count(*) filter (state <> 'MATCHED') * 100 as double) / count(*), 4)
    as pct_unmatched
  from detail group by grouping sets ((), (recon_date),
    (recon_date, merchant_account, record_type, product_id))"""
for _name, _detail in DETAILS.items():
    ORACLE[f"recon_{_name}"] = with_views(
        ["psp_payments", "charges"], _detail + " select * from detail"
    )
    ORACLE[f"recon_{_name}_levels"] = with_views(["psp_payments", "charges"], _detail + LEVELS)

ORACLE["recon_google_daily"] = ORACLE["recon_google"]
ORACLE["recon_amazon_crowded"] = with_views(
    ["crowded_payments", "crowded_charges"],
    ", psp_payments as (select * from crowded_payments), charges as (select * from crowded_charges)"
    + DETAILS["amazon"]
    + " select * from detail",
)
for _name, _provider in PROVIDERS.items():
    ORACLE[f"recon_{_name}_own"] = with_views(
        ["psp_payments", "provider_charges"],
        f""", charges as (select * from provider_charges where payment_provider = '{_provider}')"""
        + DETAILS[_name]
        + " select * from detail",
    )

for _name in [n for n in ORACLE if n.startswith("recon_amazon")]:
    ORACLE[_name] = ORACLE[_name].replace("with ", "with recursive ", 1)

ORACLE["recon_adyen_range"] = with_views(
    ["psp_payments", "charges"],
    DETAILS["adyen"]
    + """, ranged as (select * from detail
      where recon_date between date '1996-01-01' and date '1997-12-31')"""
    + LEVELS.replace("from detail", "from ranged"),
)
ORACLE["vendor_reference_lists"] = with_views(
    ["charges"],
    """, refs as (select subscription_id, vendor_reference_id as ref,
        min(cast(charged_timestamp as date)) as day
      from charges where vendor_reference_id is not null group by 1, 2),
    placed as (select *, row_number() over (partition by subscription_id order by day, ref) as nr
      from refs)
    select subscription_id, cast((nr - 1) // 5 as int) as list_nr, count(*) as "references",
      string_agg(ref, ',' order by nr) as vendor_references from placed group by 1, 2""",
)
ORACLE["settlement_recon"] = with_views(
    ["psp_payments", "charges", "exchange_rates"],
    f""", a as (select cast(charged_timestamp as date) as settle_date, currency, count(*) as n,
        cast(sum(amount) as decimal(28,6)) as total from charges group by 1, 2),
    b as (select cast(utc_timestamp as date) as settle_date, currency, count(*) as n,
        cast(sum(amount) as decimal(28,6)) as total from psp_payments group by 1, 2),
    ab as (select settle_date, currency, coalesce(a.n, 0) as charges, coalesce(b.n, 0) as payments,
        coalesce(a.total, 0) as charge_amount, coalesce(b.total, 0) as payment_amount
      from a full join b using (settle_date, currency)),
    rated as (select ab.*, case when exchange_rate = 0 then cast(0 as decimal(14,10))
        when currency = 'USD' then cast(1 as decimal(14,10))
        else {quotient('1', 'exchange_rate', 10, 'decimal(14,10)')} end as usd
      from ab left join exchange_rates x on x.currency_code = currency
        and x.exchange_rate_date = settle_date)
    select settle_date, currency, charges, payments,
      cast(charge_amount as decimal(38,6)) as charge_amount,
      cast(payment_amount as decimal(38,6)) as payment_amount,
      cast(charge_amount - payment_amount as decimal(38,6)) as difference,
      cast(cast(charge_amount - payment_amount as decimal(24,6)) * usd as decimal(38,6))
        as difference_usd from rated""",
)
ORACLE["delay_percentiles"] = with_views(
    ["delay_payments"],
    """, started as (select psp_reference, min(utc_timestamp) as t from delay_payments
      where record_type = 'Authorised' and trim(psp_reference) <> '' group by 1),
    delays as (select merchant_account, record_type,
        cast(date_diff('second', s.t, utc_timestamp) as double) as delay
      from delay_payments d join started s using (psp_reference)
      where record_type in ('Settled', 'Refunded'))
    select merchant_account, record_type, count(*) as records,"""
    + ", ".join(
        f"round(quantile_cont(delay, {p}), 6) as {n}"
        for n, p in [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)]
    )
    + " from delays group by 1, 2",
)


# Subscriptions
def trend(test: str) -> str:
    return with_views(
        ["subscriptions"],
        f""", counts as (
          select 'START' as kind, payment_provider, realm,
            cast(date_trunc('month', start_timestamp) as date) as month, count(*) as n
          from subscriptions where {test} group by 1, 2, 3, 4
          union select 'TERMINATION', payment_provider, realm,
            cast(date_trunc('month', termination_timestamp) as date), count(*)
          from subscriptions where {test} and termination_timestamp is not null group by 1, 2, 3, 4),
        spans as (select kind, payment_provider, realm, min(month) as first,
            (select max(month) from counts o where o.payment_provider = c.payment_provider
              and o.realm = c.realm) as last
          from counts c group by 1, 2, 3),
        months as (select kind, payment_provider, realm,
          cast(unnest(generate_series(first, last, interval '1 month')) as date) as month from spans),
        counted as (select m.*, coalesce(c.n, 0) as n from months m left join counts c
          on c.kind = m.kind and c.payment_provider is not distinct from m.payment_provider
          and c.realm is not distinct from m.realm and c.month = m.month)
        select a.kind, a.payment_provider, a.realm, a.month, a.n as current_month,
          coalesce(b.n, 0) as prior_month,
          round(cast((a.n - b.n) * 100 as double) / nullif(b.n, 0), 2) as kpi_value,
          a.n - coalesce(b.n, 0) as trend_value
        from counted a left join counted b on b.kind = a.kind and b.realm = a.realm
          and b.payment_provider = a.payment_provider
          and b.month = cast(a.month - interval '1' month as date)""",
    )


ORACLE["subs_trend"] = trend("true")
ORACLE["subs_trend_discovery"] = trend(f"realm in {DISCOVERY}")
LAST = """, ranked as (select *, row_number() over (partition by subscription_id
    order by updated_timestamp desc, row_id desc) as n from subscription_history),
  last as (select * exclude (n) from ranked where n = 1)"""


def active(test: str) -> str:
    return with_views(
        ["subscription_history"],
        LAST
        + f""" select payment_provider, realm, source_region, status,
          case when realm in {DISCOVERY} then count(distinct subscription_id)
            when realm in ('bolt', 'streaming') then count(distinct global_subscription_id)
            else 0 end as subscribers, count(*) as subscriptions
        from last where {test} group by 1, 2, 3, 4""",
    )




def merged(columns: str, test: str, history: str = "true") -> str:
    """Distinct subscribers over several realms: the two kinds of id are counted apart."""
    last = LAST.replace("from subscription_history)", f"from subscription_history where {history})")
    return with_views(
        ["subscription_history"],
        last
        + f""" select {columns},
          count(distinct case when realm in {DISCOVERY} then subscription_id end)
            + count(distinct case when realm in ('bolt', 'streaming') then global_subscription_id end)
            as subscribers, count(*) as subscriptions
        from last where {test} group by {columns}""",
    )


ORACLE["active_subs_bitmaps"] = active("status = 'ACTIVE'")
ORACLE["active_subs_by_provider"] = merged("payment_provider, status", "true")
ORACLE["active_subs_max_by_region"] = merged(
    "source_region", "realm in ('bolt', 'streaming')", "updated_timestamp < date '2024-01-16'"
)
ORACLE["latest_subscriptions"] = with_views(["subscription_history"], LAST + " select * from last")
ORACLE["active_subs"] = active("status = 'ACTIVE'")
ORACLE["active_subs_filtered"] = active(
    f"payment_provider = 'Roku' and realm in {DISCOVERY} and source_region = 'amer'"
)


def due(plan: str, test: str, select: str | None = None) -> str:
    columns = select or """select subscription_id, realm, payment_provider, price_plan_id,
      payment_period, plan_provider, plan_currency, plan_amount, next_due_date from due"""
    return with_views(
        ["subscriptions", "price_plans", "staged_price_plans", "billing_charges"],
        f""", plans as ({plan}), due as (
          select s.*, p.payment_period, p.plan_provider, p.plan_currency, p.plan_amount
          from subscriptions s join plans p using (price_plan_id)
          where status = 'ACTIVE' and next_due_date between date '1996-01-01' and date '2000-12-31'
            and {test}
            and not exists (select 1 from billing_charges b
              where b.subscription_id = s.subscription_id
                and b.transaction_type in ('RECURRING', 'FIRST')
                and cast(b.charged_timestamp as date) between s.next_due_date
                  and s.next_due_date + 1)) {columns}""",
    )


PLAN = """select price_plan_id, payment_period, provider as plan_provider,
  currency as plan_currency, amount as plan_amount from price_plans"""
ORACLE["subs_due"] = due(PLAN, "true")
ORACLE["subs_due_no_rub"] = due(PLAN, "plan_currency <> 'RUB'")
ORACLE["subs_due_apple"] = due(PLAN, "payment_provider = 'Apple'")
ORACLE["subs_due_bolt"] = due(
    """select p.price_plan_id, s.payment_period, s.provider as plan_provider,
      p.currency as plan_currency, p.amount as plan_amount
    from price_plans p join staged_price_plans s using (price_plan_id)""",
    "true",
)
ORACLE["subs_due_summary"] = due(
    PLAN,
    "true",
    """select next_due_date, payment_provider, payment_period, count(*) as not_billed,
      cast(sum(plan_amount) as decimal(38,6)) as plan_amount from due group by 1, 2, 3""",
)
ORACLE["affiliate_settled"] = with_views(
    ["settled_payments", "subscriptions"],
    """select affiliate, cast(date_trunc('month', utc_timestamp) as date) as settled_month,
      currency, count(*) as settled_payments, count(distinct subscription_id) as subscriptions,
      cast(sum(amount) as decimal(38,6)) as settled_amount
    from settled_payments p join subscriptions s using (subscription_id)
    where record_type = 'Settled' and affiliate is not null group by 1, 2, 3""",
)
SHARE_LEFT = "revenue_share * (max_days_in_payment_cap - days_since_start)"
SHARES = f""", terms as (
    select p.*, c.* exclude (affiliate),
      cast(datesub('month', cast(start_timestamp as date), cast(charged_timestamp as date)) as int)
        as months_since_start,
      cast(date_diff('day', start_timestamp, charged_timestamp) as int) as days_since_start,
      cast(charged_timestamp as date) as original_chg_date
    from affiliate_payments p join contracts c using (affiliate)),
  shares as (select *, case when months_since_start >= payment_cap_months
      then cast(0 as decimal(20,10))
    when months_since_start = payment_cap_months - 1 and transaction_type = 'UPGRADE'
      and payment_period = 'MONTH' then {quotient(SHARE_LEFT,
        "date_diff('day', original_chg_date, original_chg_date + interval '1' month)", 10,
        'decimal(20,10)')}
    when months_since_start = payment_cap_months - 1 and transaction_type = 'UPGRADE'
      and payment_period = 'YEAR' then {quotient(SHARE_LEFT,
        "date_diff('day', original_chg_date, original_chg_date + interval '1' year)", 10,
        'decimal(20,10)')}
    else revenue_share end as revenue_share_multiplier from terms),
  paid as (select *, cast(amount * cast(revenue_share_multiplier as decimal(14,10))
    as decimal(20,6)) as affiliate_amount from shares)"""
ORACLE["affiliate_share"] = with_views(
    ["affiliate_payments", "contracts"],
    SHARES
    + """ select affiliate, transaction_type, payment_period, months_since_start,
      count(*) as payments, cast(sum(amount) as decimal(38,6)) as amount,
      cast(sum(affiliate_amount) as decimal(38,6)) as affiliate_amount
    from paid group by 1, 2, 3, 4""",
)
ORACLE["affiliate_share_rows"] = with_views(
    ["affiliate_payments", "contracts"],
    SHARES
    + """ select affiliate, transaction_type, payment_period, charged_timestamp, start_timestamp,
      months_since_start, days_since_start, revenue_share_multiplier, affiliate_amount
    from paid""",
)

# Lifecycle
UTC = "timestamp '1970-01-01' + to_seconds(event_epoch)"
STAMPS = {
    "": UTC,
    "_pacific": f"({UTC}) at time zone 'UTC' at time zone 'America/Los_Angeles'",
}


def n(test: str) -> str:
    return f"count(*) filter ({test})"


BEFORE = """select *, lag(kind) over w as before_kind, lag(plan_rank) over w as before_rank,
  lag(term_end_epoch) over w as before_end, lag(product_plan) over w as before_plan
  from lifecycle window w as (partition by subscription_id order by event_epoch, event_id)"""
FAILURES = ", ".join(
    f"{n(f'slot = {i} and attempt_result = {chr(39)}{r}{chr(39)}')} as "
    f"{r.lower()}_{i if i <= 10 else 'later'}"
    for r in ("SUCCESS", "FAILURE")
    for i in range(1, 12)
)
LIFECYCLE = {
    "sox_acquired": (
        BEFORE,
        f"""select event_date, product_plan, count(*) as acquired,
          {n('before_kind is null')} as first_time,
          {n('before_end < event_epoch')} as true_expire,
          {n('before_end >= event_epoch and plan_rank > before_rank')} as upgrade,
          {n('before_end >= event_epoch and plan_rank < before_rank')} as downgrade
        from dated where kind = 'ACQUIRE' group by 1, 2""",
    ),
    "sox_renewals": (
        "select * from lifecycle",
        f"""select event_date as invoice_date, product_plan, {n("kind = 'RENEWAL'")} as renewals,
          {n("kind = 'CANCEL' and coalesce(reason, '') in ('AUTO_RENEW_OFF', 'REFUND')")}
            as voluntary_churn,
          {n("kind = 'CANCEL' and coalesce(reason, '') not in ('AUTO_RENEW_OFF', 'REFUND')")}
            as involuntary_churn, {n("kind = 'SWITCH'")} as switches
        from dated where kind in ('RENEWAL', 'CANCEL', 'SWITCH') group by 1, 2""",
    ),
    "sox_trials": (
        """select subscription_id, event_epoch,
          exists (select 1 from lifecycle b where b.subscription_id = t.subscription_id
            and b.kind in ('ACQUIRE', 'RENEWAL') and b.event_epoch > t.event_epoch
            and (t.then_at is null or (b.event_epoch, b.event_id) < (t.then_at, t.then_id))) as paid,
          exists (select 1 from lifecycle b where b.subscription_id = t.subscription_id
            and b.kind = 'CANCEL' and b.event_epoch > t.event_epoch
            and (t.then_at is null or (b.event_epoch, b.event_id) < (t.then_at, t.then_id)))
            as left_again
        from (select *, lead(event_epoch) over next_one as then_at, lead(event_id) over next_one as then_id
          from lifecycle where kind = 'TRIAL'
          window next_one as (partition by subscription_id order by event_epoch, event_id)) t""",
        f"""select event_date as signup_date, count(*) as signups, {n('paid')} as conversions,
          {n('not paid and left_again')} as cancellations,
          {n('not paid and not left_again')} as open_trials from dated group by 1""",
    ),
    "sox_cancel": (
        "select * from lifecycle where kind = 'CANCEL'",
        """select event_date, product_plan, case reason when 'HARD_DECLINE' then 'hard decline'
          when 'SOFT_DECLINE' then 'soft decline' when 'REFUND' then 'refund'
          when 'AUTO_RENEW_OFF' then 'auto-renew-off' when 'CHARGEBACK' then 'chargeback'
          else 'other' end as cancellation_class, count(*) as cancellations
        from dated group by 1, 2, 3""",
    ),
    "sox_failures": (
        """select *, least(row_number() over (partition by invoice_id
          order by event_epoch, event_id), 11) as slot from lifecycle where kind = 'PAYMENT'""",
        f"""select event_date as invoice_date, product_plan, count(*) as attempts, {FAILURES}
        from dated group by 1, 2""",
    ),
    "sox_switches": (
        BEFORE,
        """select event_date, before_plan as from_plan, product_plan as to_plan,
          case when plan_rank > before_rank then 'upgrade' when plan_rank < before_rank
            then 'downgrade' else 'sidegrade' end as direction, count(*) as switches
        from dated where kind = 'SWITCH' and before_plan <> product_plan group by 1, 2, 3, 4""",
    ),
    "erp_extract": (
        "select * from lifecycle where kind in ('ACQUIRE', 'RENEWAL')",
        """select strftime(event_date, '%d-%m-%Y') as "GL_DATE",
          'SUBS-' || upper(product_plan) as "LINE_TYPE", currency as "CURRENCY_CODE",
          cast(count(*) as varchar) as "QUANTITY",
          cast(cast(sum(amount) as decimal(30,2)) as varchar) as "AMOUNT"
        from dated group by event_date, product_plan, currency""",
    ),
}
for _name, (_rows, _report) in LIFECYCLE.items():
    for _suffix, _stamp in STAMPS.items():
        ORACLE[_name + _suffix] = with_views(
            ["lifecycle"],
            f", chosen as ({_rows}), dated as (select *, cast({_stamp} as date) as event_date "
            f"from chosen) {_report}",
        )
ORACLE["sox_active"] = with_views(
    ["lifecycle"],
    """, ranked as (select *, row_number() over (partition by subscription_id
      order by event_epoch desc, event_id desc) as nr from lifecycle)
    select product_plan, vod_type, price_plan, promo, billing_anchor,
      count(*) as active_subscribers
    from ranked where nr = 1 and kind <> 'CANCEL' group by 1, 2, 3, 4, 5""",
)
for _zone, _stamp in STAMPS.items():
    ORACLE[f"sox_active_weekly{_zone}"] = with_views(
        ["lifecycle"],
        f""", days as (select cast(unnest([{", ".join(f"date '{d}'" for d in SNAPSHOTS)}]) as date) as snapshot_date),
        stamped as (select *, cast({_stamp} as date) as event_date from lifecycle),
        ranked as (select s.*, snapshot_date, row_number() over (partition by snapshot_date, subscription_id
          order by event_epoch desc, event_id desc) as nr
          from days join stamped s on s.event_date <= snapshot_date)
        select snapshot_date, product_plan, vod_type, price_plan, promo, billing_anchor,
          count(*) as active_subscribers
        from ranked where nr = 1 and kind <> 'CANCEL' group by 1, 2, 3, 4, 5, 6""",
    )
ORACLE["pacific_variant"] = with_views(
    ["lifecycle"],
    f"""select event_id, event_epoch, {STAMPS['_pacific']} as event_ts,
      cast({STAMPS['_pacific']} as date) as event_date from lifecycle""",
)

# Cases
ORACLE["case_states_l1"] = with_views(
    ["case_states"],
    """select state, cast(state_timestamp as date) as state_date, count(*) as records
    from case_states group by 1, 2""",
)
ORACLE["case_states_l2"] = with_views(
    ["case_states"],
    """select record_id, state, state_timestamp, cast(state_timestamp as date) as state_date
    from case_states where state = 'IN_REVIEW'
      and cast(state_timestamp as date) between date '2024-01-05' and date '2024-01-20'""",
)


# Landing


def landed(provider: str, view: str) -> str:
    """The raw rows as their lines give them back: blanks to NULL, cut to the width, blank where the view has
    no such column."""
    columns = ", ".join(
        f"left(case when trim({c}) <> '' then {c} end, {n}) as {c}" for c, n in raw_widths(provider).items()
    )
    return f"select {columns} from {view}"


for _provider, _view in (("apple", "raw_apple"), ("amazon", "raw_amazon"), ("direct_billing", "raw_billing")):
    ORACLE[f"land_{_provider}"] = with_views([_view], landed(_provider, _view))
ORACLE["land_rejects"] = with_views(
    ["raw_amazon"],
    """ select case when l.i % 13 = 0 then 'fields' when l.receipt_id is null then 'missing receipt_id'
        else 'landed' end as reason, count(*) as lines
      from (select receipt_id, cast(split_part(substr(transaction_id, 2), '-', 1) as bigint) as i
        from raw_amazon) l group by 1""",
)


# Loads

SENT = """, sent as (select *, cast(substr(transaction_time, 9, 2) as int) as day from raw_amazon
    where substr(transaction_time, 1, 7) = '1996-03' and cast(substr(transaction_time, 9, 2) as int) <= 20),
  apple as (select * from raw_apple where file_tx_id = 'f_Apple_1996-03')"""


def loads(select: str) -> str:
    return with_views(["raw_amazon", "raw_apple"], SENT + select)


ORACLE["load_audit"] = loads(
    """ select 'd' || n as file_tx_id, 'Amazon_AMER' as data_source,
      'amazon_go_sales_1996-03-' || lpad(cast(n as varchar), 2, '0') || '.csv' as data_file,
      case when n = 20 then 'LOADED_FACT' else 'SUPERSEDED' end as status,
      (select count(*) from sent where day <= n) as record_count_staging
    from (values (5), (10), (20)) f(n)
    union all select 'apple', 'Apple_AMER', 'apple.txt', 'LOADED_FACT', (select count(*) from apple)"""
)
UTC_TIME = AMAZON_TYPED.split(" as transaction_time_utc")[0].rsplit("transaction_time_local_tz,", 1)[1].strip()
ORACLE["load_payments"] = loads(
    f""" select 'd20' as file_tx_id, transaction_id,
      cast(sales_price_marketplace_currency as decimal(20,6)) as main_amount,
      {UTC_TIME} as utc_timestamp,
      coalesce(receipt_id, '') || '~' || cast({UTC_TIME} as varchar) || '~' || transaction_type || '~' as record_key
    from sent"""
)
ORACLE["load_closed_files"] = loads(
    """ select 'd' || n as file_tx_id, (select count(*) from sent where day <= n) as closed_rows, n = 20 as in_force
    from (values (10), (20)) f(n)"""
)
REVENUE = """select 'Amazon' as payment_provider, vendor_sku as sku_id, 'd20' as file_tx_id,
      sum(abs(cast(sales_price_marketplace_currency as decimal(20,6)))) as revenue,
      bool_or(transaction_type = 'Charge' and item_type = 'Subscription') as eligible
    from sent where vendor_sku is not null group by 1, 2
    union all select 'Apple', sku, 'apple', sum(abs(cast(customer_price as decimal(20,6))) * cast(units as int)), true
    from apple where subscription in ('New', 'Renewal') group by 1, 2"""
ORACLE["load_sku_sales"] = loads(
    f""" select payment_provider, sku_id, 'AMER' as file_tx_region, file_tx_id,
      cast(revenue as decimal(38,6)) as value from ({REVENUE})"""
)
ORACLE["load_skus"] = loads(
    f""" select payment_provider, sku_id, 'AMER' as file_tx_region,
      case when revenue > 0 and not (sku_id ilike '%.foodnetwork.%' or sku_id ilike '%golftv%' or sku_id ilike '%ppv%')
        then 'Y' else 'N' end as included_in_accrual_yn
    from ({REVENUE}) where eligible"""
)
ORACLE["load_master"] = loads(
    """ select 'm' as mv_id, 'd' || n as file_tx_id,
      case when n = 20 then 'LOADED_FACT' else 'SUPERSEDED' end as load_status,
      (select count(*) from sent where day <= n) as raw_transaction_count,
      (select count(*) from sent where day <= n) as final_transaction_count,
      case when n = 20 then (select count(*) from sent) else 0 end as fact_transaction_count
    from (values (5), (10), (20)) f(n)"""
)
ORACLE["load_monitor_stamp"] = """select 'm' as mv_id, 'ENABLED' as mv_status, date '1996-03-05' as mv_min_date,
  date '1996-03-20' as mv_max_date, cast(3 as bigint) as mv_row_count"""
