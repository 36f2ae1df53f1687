from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tillroll.functions.clock import from_epoch, in_zone, months_since
from tillroll.operators.facts import to_fact
from tillroll.operators.staging import TYPERS, clean_raw, type_amazon, type_apple, type_google
from tillroll.sources.schemas import PAYMENTS, PROVIDERS, ddl, raw_schema, typed_schema


def raw(spark, provider, **fields):
    columns = raw_schema(provider)
    return spark.createDataFrame([tuple(fields.get(c) for c in columns)], ddl(columns))


@pytest.mark.parametrize(
    ("text", "zone", "utc_hour"),
    [
        ("2024-01-15 12:00:00 UTC", "UTC", 12),
        ("2024-01-15 12:00:00 PST", "PST", 20),
        ("2024-07-15 12:00:00 PDT", "PDT", 19),
        ("2024-07-15 12:00:00 PST", "PST", 20),
        ("2024-01-15 12:00:00", "", 12),
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_amazon_times(spark, text, zone, utc_hour, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        row = type_amazon(raw(spark, "amazon", transaction_time=text), "AMER").collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.transaction_time_local.hour == 12
    assert row.transaction_time_local_tz == zone
    assert row.transaction_time_utc.hour == utc_hour
    assert row.file_tx_region == "AMER"


@pytest.mark.parametrize(
    ("text", "day"),
    [("01/05/2024", date(2024, 1, 5)), ("1/5/2024", date(2024, 1, 5)), ("", None), ("  ", None)],
)
def test_apple_dates(spark, text, day):
    row = type_apple(raw(spark, "apple", begin_date=text, end_date=text), "AMER").collect()[0]
    assert (row.begin_date, row.end_date) == (day, day)


def test_bad_numbers_and_dates_raise(spark):
    for fields in (
        {"units": "1.5"},
        {"customer_price": "123456789012345.1"},
        {"begin_date": "2024-01-05"},
    ):
        with pytest.raises(Exception, match="CAST_INVALID|OUT_OF_RANGE|CANNOT_PARSE"):
            type_apple(raw(spark, "apple", **fields), "AMER").collect()


def test_typed_tables_have_their_schema(spark):
    for provider in PROVIDERS:
        typed = TYPERS[provider](raw(spark, provider), "AMER")
        got = {f.name: f.dataType.simpleString() for f in typed.schema}
        assert got == typed_schema(provider)
        assert list(got) == list(typed_schema(provider))
    assert "file_tx_region" not in typed_schema("direct_billing")


def test_a_missing_raw_column_raises(spark):
    for provider in PROVIDERS:
        for column in raw_schema(provider):
            if column not in ("currency", "amount", "begin_date", "end_date", "transaction_time"):
                break
        with pytest.raises(ValueError, match=column):
            TYPERS[provider](raw(spark, provider).drop(column), "AMER")


def test_fact_rows_have_the_fact_schema(spark):
    for provider in ("amazon", "google", "roku", "direct_billing"):
        rows = to_fact(provider, TYPERS[provider](raw(spark, provider), "AMER"))
        assert {f.name: f.dataType.simpleString() for f in rows.schema} == PAYMENTS


def test_record_key_is_null_without_time_or_type(spark):
    fields = {"receipt_id": None, "transaction_time": "2024-01-15 12:00:00 UTC"}
    whole = raw(spark, "amazon", transaction_type="Charge", **fields)
    part = raw(spark, "amazon", **fields)
    keys = [
        to_fact("amazon", type_amazon(df, "AMER")).collect()[0].record_key for df in (whole, part)
    ]
    assert keys == ["~2024-01-15 12:00:00~Charge~", None]


def test_blank_fields_become_null_and_long_ones_are_cut(spark):
    df = raw(spark, "google", buyer_country=" \t ", buyer_currency="X" * 30, product_id="")
    row = clean_raw(df, "google").collect()[0]
    assert (row.buyer_country, row.product_id) == (None, None)
    assert row.buyer_currency == "X" * 20


def test_google_dates(spark):
    row = type_google(
        raw(
            spark,
            "google",
            order_charged_date="2024-01-05",
            order_charged_timestamp="2024-01-05 23:59:59",
        ),
        "EMEA",
    ).collect()[0]
    assert row.order_charged_date == date(2024, 1, 5)
    assert row.order_charged_timestamp == datetime(2024, 1, 5, 23, 59, 59)


def test_epoch_and_pacific(spark):
    df = spark.createDataFrame([(1705320000,), (1721044800,)], "e bigint")
    rows = df.select(
        from_epoch(F.col("e")).alias("utc"), in_zone(from_epoch(F.col("e"))).alias("local")
    ).collect()
    assert [(r.utc.hour, r.local.hour) for r in rows] == [(12, 4), (12, 5)]


@pytest.mark.parametrize(
    ("start", "at", "months"),
    [
        ("2024-01-31", "2024-02-28", 0),
        ("2024-01-31", "2024-02-29", 1),
        ("2024-01-30", "2024-02-29", 1),
        ("2024-01-15", "2025-01-14", 11),
        ("2024-01-15", "2025-01-15", 12),
        ("2024-01-15", "2024-01-15", 0),
    ],
)
def test_whole_months(spark, start, at, months):
    df = spark.createDataFrame([(start, at)], "s string, a string")
    row = df.select(months_since(F.col("s").cast("date"), F.col("a").cast("date"))).collect()[0]
    assert row[0] == months
