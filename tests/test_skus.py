from datetime import date, datetime
from decimal import Decimal

import pytest

from tillroll.operators.skus import (
    classify_apple_skus,
    classify_payment_skus,
    new_sku_alert,
    promote_skus,
)
from tillroll.sources.schemas import SKUS, ddl

PAYMENT = (
    "pmt_channel string, vendor_sku string, file_tx_region string, record_type string, "
    "type string, main_amount decimal(20,6), utc_timestamp timestamp_ntz"
)
APPLE = (
    "sku string, file_tx_region string, subscription string, customer_price decimal(20,6), "
    "units int, end_date date"
)
WHEN = datetime(2024, 1, 5, 10)


def no_skus(spark):
    return spark.createDataFrame([], ddl(SKUS))


def sale(sku, region, channel="Amazon", record="Charge", kind="Subscription", amount="1"):
    value = None if amount is None else Decimal(amount)
    return (channel, sku, region, record, kind, value, WHEN)


def classified(spark, *rows, known=None):
    df = spark.createDataFrame(list(rows), PAYMENT)
    return classify_payment_skus(df, known or no_skus(spark)).collect()


def apple_classified(spark, *rows):
    df = spark.createDataFrame(list(rows), APPLE)
    return classify_apple_skus(df, no_skus(spark)).collect()


def apple_sale(sku, region, price="1", units=1, subscription="New"):
    return (sku, region, subscription, Decimal(price), units, date(2024, 1, 5))


REALMS = [
    ("a", "AMER", "go"), ("a", "EMEA", "dplay"), ("a", "APAC", "streaming_apac"),
    ("a", "MAX", "streaming"), ("a", "MAXTR", "streaming"), ("a", "CNN", "streaming"),
    ("a", "ESP", "eurosport"), ("a", "MT", "motortrend"), ("a", "INDIA", "streaming_india"),
    ("a", "MARS", None), ("br_a", "DPLUS", "go"), ("brx", "DPLUS", "go"), ("ca_a", "DPLUS", "go"),
    ("us_a", "DPLUS", "go"), ("dplus_a", "DPLUS", "go"), ("de.a", "DPLUS", "dplay"),
    ("ie_a", "DPLUS", "dplay"), ("uk_a", "DPLUS", "dplay"), ("zz_a", "DPLUS", "go"),
]
SOURCES = [
    ("x.us.a", "MAX", "amer"), ("stream.a", "MAX", "amer"), ("x.latam.a", "MAX", "latam"),
    ("x.lat.a", "MAX", "latam"), ("a.emea", "MAX", "emea"), ("a.apac", "MAX", "apac"),
    ("a", "MAX", "amer"), ("a", "MAXTR", "emea"), ("a", "CNN", "cnn"), ("a", "AMER", None),
    ("stream.latam.emea", "MAX", "amer"),
]
NAMES = [
    ("x.annual", "YEAR", "ad_free"), ("x.year", "YEAR", "ad_free"), ("x.1y.a", "YEAR", "ad_free"),
    ("X.12month.lite", "YEAR", "ad_lite"), ("x.12m.a", "YEAR", "ad_free"),
    ("x.3month", "MONTH", "ad_free"), ("x.monthly", "MONTH", "ad_free"),
    ("x.1m.a", "MONTH", "ad_free"), ("x", "MONTH", "ad_free"),
    ("a.premium.avod", "MONTH", "premium"), ("a.svod.lite", "MONTH", "ad_free"),
    ("a.avod", "MONTH", "ad_lite"), ("a.light", "MONTH", "ad_lite"), ("a.free", "MONTH", "ad_free"),
]


def test_realms(spark):
    got = {
        (r.sku_id, r.file_tx_region): r.realm
        for r in classified(spark, *[sale(s, g) for s, g, _ in REALMS])
    }
    assert got == {(s, g): realm for s, g, realm in REALMS}


def test_source_regions(spark):
    got = {
        (r.sku_id, r.file_tx_region): r.source_region
        for r in classified(spark, *[sale(s, g) for s, g, _ in SOURCES])
    }
    assert got == {(s, g): source for s, g, source in SOURCES}


def test_periods_and_tiers(spark):
    got = {
        r.sku_id: (r.payment_period, r.tier_type)
        for r in classified(spark, *[sale(s, "AMER") for s, _, _ in NAMES])
    }
    assert got == {s: (period, tier) for s, period, tier in NAMES}


@pytest.mark.parametrize(
    ("row", "flag"),
    [
        (sale("a", "AMER"), "Y"),
        (sale("a", "APAC"), "N"),
        (sale("a", "MT"), "N"),
        (sale("a", None), "Y"),
        (sale("x.foodnetwork.a", "AMER"), "N"),
        (sale("golftv.a", "AMER"), "N"),
        (sale("a.PPV", "AMER"), "N"),
        (sale("a", "AMER", amount="0"), "N"),
        (sale("a", "AMER", amount=None), "N"),
        (sale("a", "AMER", "Google", "Charged", "SUBSCRIPTION"), "Y"),
        (sale("a", "AMER", "Roku", "UpgradeSale", "any"), "Y"),
    ],
)
def test_accrual_flag(spark, row, flag):
    (got,) = classified(spark, row)
    assert got.included_in_accrual_yn == flag
    assert (got.auto_generated_yn, got.partner_revenue_share) == ("Y", Decimal("0.000000"))
    assert got.sku_create_timestamp == WHEN


@pytest.mark.parametrize(
    "row",
    [
        sale("a", "AMER", record="Refund"),
        sale("a", "AMER", kind="subscription"),
        sale(None, "AMER"),
        sale("a", "AMER", "Google", "Refund", "Subscription"),
        sale("a", "AMER", "Roku", "Refund"),
        sale("a", "AMER", "DirectBilling"),
    ],
)
def test_rows_that_show_no_sku(spark, row):
    assert classified(spark, row) == []


def test_one_row_per_sku_whatever_its_types(spark):
    rows = [sale("a", "AMER", "Roku", "Purchase", kind) for kind in ("x", "y")]
    assert len(classified(spark, *rows)) == 1


def test_amounts_that_cancel_out_are_no_revenue(spark):
    (got,) = classified(spark, sale("a", "AMER", amount="5"), sale("a", "AMER", amount="-5"))
    assert got.included_in_accrual_yn == "N"


def test_known_skus_are_left_out_per_channel_and_region(spark):
    known = spark.createDataFrame(
        [("Amazon", "go", None, "AMER", "a", "MONTH", "ad_free", "N", Decimal(0), WHEN, "N")],
        ddl(SKUS),
    )
    rows = [sale("a", "AMER"), sale("a", "EMEA"), sale("a", "AMER", "Roku", "Purchase")]
    got = {(r.payment_provider, r.file_tx_region) for r in classified(spark, *rows, known=known)}
    assert got == {("Amazon", "EMEA"), ("Roku", "AMER")}


def test_apple_knows_fewer_patterns(spark):
    rows = apple_classified(
        spark,
        apple_sale("ie_a", "DPLUS"), apple_sale("uk_a", "DPLUS"), apple_sale("a.light", "AMER"),
        apple_sale("a.1y.b", "AMER"), apple_sale("a", "MAXTR"), apple_sale("a", "MT"),
        apple_sale("a", "APAC"), apple_sale("b", "AMER", "5", 0),
        apple_sale("c", "AMER", subscription="Refund"),
    )
    got = {(r.sku_id, r.file_tx_region): r for r in rows}
    assert got["ie_a", "DPLUS"].realm == "go"
    assert got["uk_a", "DPLUS"].realm == "dplay"
    assert got["a.light", "AMER"].tier_type == "ad_free"
    assert got["a.1y.b", "AMER"].payment_period == "MONTH"
    assert got["a", "MAXTR"].source_region is None
    assert got["a", "MT"].included_in_accrual_yn == "Y"
    assert got["a", "APAC"].included_in_accrual_yn == "N"
    assert got["b", "AMER"].included_in_accrual_yn == "N"
    assert ("c", "AMER") not in got
    assert got["uk_a", "DPLUS"].sku_create_timestamp == datetime(2024, 1, 5)


def reference(sku, provider="Amazon", region="AMER", included="N", generated="Y"):
    return (
        provider, "go", None, region, sku, "MONTH", "ad_free", included, Decimal(0), WHEN, generated,
    )


def test_promotion(spark):
    ref = spark.createDataFrame(
        [
            reference("earns"), reference("idle"), reference("manual", generated="N"),
            reference("x.ppv"), reference("earns", region="APAC"), reference("earns", "Roku"),
            reference("sold", "Apple"), reference("returned", "Apple"),
            reference("done", included="Y"),
        ],
        ddl(SKUS),
    )
    payments = spark.createDataFrame(
        [sale(s, g, record="Refund", amount="-3") for s, g in (
            ("earns", "AMER"), ("manual", "AMER"), ("x.ppv", "AMER"), ("earns", "APAC"))]
        + [sale("idle", "AMER", amount="0"), sale("sold", "AMER")],
        PAYMENT,
    )
    apple = spark.createDataFrame(
        [apple_sale("sold", "AMER"), apple_sale("returned", "AMER", "5", -1)], APPLE
    )
    out = promote_skus(ref, payments, apple).collect()
    assert len(out) == 9
    turned = {
        (r.payment_provider, r.sku_id, r.file_tx_region)
        for r in out
        if r.included_in_accrual_yn == "Y"
    }
    assert turned == {
        ("Amazon", "earns", "AMER"), ("Apple", "sold", "AMER"), ("Amazon", "done", "AMER"),
    }


def test_alert_lists_unknown_skus(spark):
    rows = spark.createDataFrame(
        [("Amazon", "a", "AMER", WHEN), ("Amazon", "b", "AMER", WHEN), ("Amazon", None, "AMER", WHEN)],
        "payment_provider string, sku_id string, file_tx_region string, seen_at timestamp_ntz",
    )
    ref = spark.createDataFrame([reference("a")], ddl(SKUS))
    assert [(r.sku_id, r.rows) for r in new_sku_alert(rows, ref).collect()] == [("b", 1)]
