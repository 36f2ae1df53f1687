from datetime import date, datetime
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from tillroll.functions.clock import rolling_months
from tillroll.operators.accrual import AccrualLookups, accrual, daily_accrual, daily_average_rates

PAYMENT = (
    "pmt_channel string, psp_reference string, vendor_sku string, net decimal(20,6), "
    "main_amount decimal(20,6), main_currency string, issuer_country string, record_type string, "
    "type string, file_tx_region string, utc_timestamp timestamp_ntz, utc_date date"
)
AS_OF = date(2024, 6, 1)


def pay(region="AMER", currency="USD", country="US", amount="12.00", sku="m", at="2024-02-10",
        channel="Amazon", record="Charge", kind="Subscription"):
    return (channel, "p", sku, D("1"), D(amount), currency, country, record, kind, region,
            datetime.fromisoformat(at), date.fromisoformat(at[:10]))


def lookups(spark, **changed):
    regions = ("AMER", "EMEA", "MAX", "ESP", "CNN")
    skus = [
        (channel, sku, region, period, "ad_free", flag, D("0.5"))
        for channel in ("Amazon", "Google", "Roku")
        for region in regions
        for sku, period, flag in (
            ("m", "MONTH", "Y"), ("y", "YEAR", "Y"), ("off", "MONTH", "N"), ("week", "WEEK", "Y"),
        )
    ]
    days = [date(2024, 2, 10), date(2024, 2, 29), date(2024, 1, 15)]
    rates = [
        (c, d, D(r))
        for c, r in (("USD", "1"), ("EUR", "0.8"), ("GBP", "0.5"), ("ZZZ", "0"))
        for d in days
    ]
    tables = {
        "fallback_country": (
            [("USD", "US"), ("GBP", "GB")], "currency_code string, country_code string",
        ),
        "skus": (
            skus,
            "payment_provider string, sku_id string, file_tx_region string, payment_period string,"
            " tier_type string, included_in_accrual_yn string, "
            "partner_revenue_share decimal(20,6)",
        ),
        "exchange_rates": (
            rates,
            "currency_code string, exchange_rate_date date, exchange_rate decimal(20,6)",
        ),
        "vat": ([("gb", D("0.2"))], "country_code string, vat_rate decimal(10,4)"),
        "commission": (
            [("StreamCo", "Amazon", "All", D("0.2")), ("MaxStream", "Amazon", "All", D("0.15"))],
            "company string, provider string, area string, commission_rate decimal(10,4)",
        ),
    }
    tables.update(changed)
    return AccrualLookups(**{n: spark.createDataFrame(*spec) for n, spec in tables.items()})


def run(spark, *rows, channels=("Amazon",), **changed):
    payments = spark.createDataFrame(list(rows), PAYMENT)
    return accrual(payments, lookups(spark, **changed), AS_OF, channels).collect()


def test_a_monthly_charge_with_vat(spark):
    (row,) = run(spark, pay("EMEA", "GBP", "GB"))
    assert (row.realm, row.source_region, row.company) == ("dplay", "emea", "StreamCo")
    assert (row.vat_rate, row.vat_amount, row.revenue) == (D("0.2"), D("2"), D("10"))
    assert (row.commission, row.days_in_period) == (D("2"), 29)
    assert row.daily_revenue_rate == D("0.344828")
    assert row.daily_commission_rate == D("0.068966")
    assert (row.exchange_rate_to_usd, row.reporting_currency) == (D("2"), "GBP")
    assert row.reporting_currency_exchange_rate == D("1")


@pytest.mark.parametrize(
    ("sku", "at", "days"),
    [
        ("m", "2024-02-10", 29), ("m", "2024-01-15", 31), ("y", "2024-02-29", 365),
        ("y", "2024-01-15", 366),
    ],
)
def test_days_in_period(spark, sku, at, days):
    (row,) = run(spark, pay(sku=sku, at=at + " 23:30:00"))
    assert row.days_in_period == days


@pytest.mark.parametrize(
    ("currency", "at", "rate"),
    [
        ("USD", "2024-02-10", D("1")),
        ("USD", "2024-02-11", D("1")),
        ("EUR", "2024-02-10", D("1.25")),
        ("EUR", "2024-02-11", None),
        ("ZZZ", "2024-02-10", D("0")),
    ],
)
def test_rates_to_usd(spark, currency, at, rate):
    (row,) = run(spark, pay(currency=currency, at=at))
    assert row.exchange_rate_to_usd == rate


def test_a_zero_rate_wins_over_usd(spark):
    rates = (
        [("USD", date(2024, 2, 10), D("0"))],
        "currency_code string, exchange_rate_date date, exchange_rate decimal(20,6)",
    )
    (row,) = run(spark, pay(), exchange_rates=rates)
    assert (row.exchange_rate_to_usd, row.reporting_currency_exchange_rate) == (D("0"), D("0"))


@pytest.mark.parametrize(
    ("country", "currency", "code"),
    [("US", "USD", "us"), ("", "USD", "us"), (None, "GBP", "gb"), ("**", "GBP", "gb"),
     (" ", "USD", "us"), ("", "EUR", None)],
)
def test_country_falls_back_to_the_currency(spark, country, currency, code):
    (row,) = run(spark, pay(currency=currency, country=country))
    assert row.country_code == code


@pytest.mark.parametrize(
    ("region", "country", "currency", "share"),
    [("ESP", "DE", "EUR", "0"), ("ESP", "GB", "EUR", "0.5"), ("ESP", "", "EUR", "0.5"),
     ("AMER", "DE", "EUR", "0.5")],
)
def test_partner_share(spark, region, country, currency, share):
    (row,) = run(spark, pay(region, currency, country))
    assert row.partner_rev_share == D(share)


def test_region_tags(spark):
    rows = run(spark, *[pay(g) for g in ("AMER", "EMEA", "MAX", "ESP", "CNN", "APAC", "INDIA")])
    got = {r.file_tx_region: (r.realm, r.source_region, r.company) for r in rows}
    assert got == {
        "AMER": ("go", "amer", "StreamCo"), "EMEA": ("dplay", "emea", "StreamCo"),
        "MAX": ("streaming", "max", "MaxStream"), "ESP": ("eurosport", None, "StreamCo"),
        "CNN": ("", None, "MaxStream"),
    }


@pytest.mark.parametrize(
    "row",
    [
        pay(record="Refund"), pay(kind="Consumable"), pay(sku="off"), pay(sku="week"),
        pay(sku="unknown"), pay(at="2024-06-01"), pay(at="2022-05-31 23:59:59"),
        pay(channel="Google", record="Charged"),
    ],
)
def test_rows_that_are_not_accrued(spark, row):
    assert run(spark, row) == []


def test_the_window_starts_24_months_back(spark):
    assert len(run(spark, pay(at="2022-06-01"), pay(at="2024-05-31 23:59:59"))) == 2


def test_other_channels_on_request(spark):
    rows = run(
        spark, pay(), pay(channel="Google", record="Charged", kind="subscription"),
        pay(channel="Roku", record="Purchase", kind="x"), channels=("Amazon", "Google", "Roku"),
    )
    got = {r.payment_provider: r.commission for r in rows}
    assert got == {"Amazon": D("2.4"), "Google": None, "Roku": None}


@pytest.mark.parametrize(
    ("table", "rows", "schema"),
    [
        ("vat", [("us", D("0.1")), ("us", D("0.2"))], "country_code string, vat_rate decimal(10,4)"),
        ("fallback_country", [("USD", "US"), ("USD", "CA")],
         "currency_code string, country_code string"),
        ("commission", [("StreamCo", "Amazon", "All", D("0.2"))] * 2,
         "company string, provider string, area string, commission_rate decimal(10,4)"),
        ("exchange_rates", [("USD", date(2024, 2, 10), D("1"))] * 2,
         "currency_code string, exchange_rate_date date, exchange_rate decimal(20,6)"),
    ],
)
def test_a_repeated_lookup_key_raises(spark, table, rows, schema):
    with pytest.raises(Exception, match="repeats the key"):
        run(spark, pay(), **{table: (rows, schema)})


def test_the_lookup_test_survives_column_pruning(spark):
    payments = spark.createDataFrame([pay()], PAYMENT)
    vat = ([("us", D("0.1"))] * 2, "country_code string, vat_rate decimal(10,4)")
    rows = accrual(payments, lookups(spark, vat=vat), AS_OF)
    with pytest.raises(Exception, match="repeats the key"):
        rows.select("revenue").collect()


def test_daily_totals(spark):
    payments = spark.createDataFrame([pay(), pay(), pay(sku="y")], PAYMENT)
    rows = daily_accrual(accrual(payments, lookups(spark), AS_OF)).collect()
    got = {r.payment_period: (r.charges, r.revenue) for r in rows}
    assert got == {"MONTH": (2, D("24")), "YEAR": (1, D("12"))}


def test_daily_average_rates(spark):
    quotes = spark.createDataFrame(
        [("EUR", datetime(2024, 1, 1, 1), D("0.8")), ("EUR", datetime(2024, 1, 1, 23), D("0.9")),
         ("EUR", datetime(2024, 1, 2), D("1"))],
        "currency_code string, quoted_at timestamp_ntz, exchange_rate decimal(20,6)",
    )
    got = {r.exchange_rate_date.day: r.exchange_rate for r in daily_average_rates(quotes).collect()}
    assert got == {1: D("0.85"), 2: D("1")}


def test_the_window_skips_row_groups(spark, tmp_path):
    """Of a file sorted by time, as loads write it, only the row groups of the window are read."""
    first = F.lit(date(2014, 1, 1))
    days = spark.range(0, 400_000, numPartitions=1).select(
        F.date_add(first, (F.col("id") / 100).cast("int")).alias("utc_date"), F.col("id").alias("n")
    )
    path = str(tmp_path / "sorted")
    days.write.option("parquet.block.size", 64 * 1024).option("parquet.page.size", 8 * 1024).parquet(path)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wanted = spark.read.parquet(path).where(rolling_months(F.col("utc_date"), AS_OF, 12))
        rows = wanted.collect()
        scan = wanted._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(rows) == 36_600
    assert read < 100_000
