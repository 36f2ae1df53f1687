"""The registered queries: each runs an operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll_checks.inputs import SNAPSHOTS, view
from tillroll_checks.loads import loaded, scratch_tables
from tillroll.functions import clock, money, realms, text
from tillroll.operators import (
    accrual as acc,
)
from tillroll.operators import (
    facts,
    files,
    lifecycle,
    monitor,
    recon,
    skus,
    staging,
    subscriptions,
)
from tillroll.plans.reconcile import reconcile_day, reconciled
from tillroll.plans.refresh import refresh_subscribers, stored_subscribers
from tillroll.sources import landing
from tillroll.sources.schemas import raw_widths

AS_OF = date(2001, 12, 1)
MONITOR_AS_OF = date(2001, 6, 15)
DUE_FROM, DUE_TO = date(1996, 1, 1), date(2000, 12, 31)
RECON_FROM, RECON_TO = date(1996, 1, 1), date(1997, 12, 31)
SUBSCRIBERS_AS_OF = date(2024, 1, 15)
CASE_FROM, CASE_TO = date(2024, 1, 5), date(2024, 1, 20)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def add(name: str, function: Query) -> None:
    QUERIES[name] = function


# Money


@query
def minor_units(spark, d):
    amount = money.minor_to_major(F.col("amount_minor"), F.col("currency"))
    return view(spark, d, "minor_amounts").withColumn("amount", amount)


@query
def currency_exponents(spark, d):
    code = F.col("currency")
    return view(spark, d, "minor_amounts").select(
        "*",
        money.exponent(code).alias("exponent"),
        money.is_zero_decimal(code).alias("zero_decimal"),
        money.is_three_decimal(code).alias("three_decimal"),
    )


@query
def round_to_exponent(spark, d):
    eighth = (F.col("amount_minor") / F.lit(8)).cast("decimal(20,6)")
    return view(spark, d, "minor_amounts").withColumn(
        "rounded", money.round_to_exponent(eighth, F.col("currency"))
    )


@query
def format_amount(spark, d):
    code = F.col("currency")
    amount = money.minor_to_major(F.col("amount_minor"), code)
    return view(spark, d, "minor_amounts").withColumn("shown", money.format_amount(amount, code))


@query
def normalise_amounts(spark, d):
    df = view(spark, d, "minor_amounts")
    return money.normalise_amounts(df, "amount_minor", "currency")


# Landing and typing


@query
def raw_null_truncate(spark, d):
    df = view(spark, d, "raw_text")
    return df.select(
        "doc_id",
        text.clip(text.blank_to_null(F.col("text")), 3000).alias("text"),
        text.blank_to_null(F.col("source")).alias("source"),
    )


@query
def type_apple(spark, d):
    return staging.type_apple(view(spark, d, "raw_apple"), "AMER")


@query
def type_amazon(spark, d):
    return staging.type_amazon(view(spark, d, "raw_amazon"), "EMEA")


@query
def type_google(spark, d):
    return staging.type_google(view(spark, d, "raw_google"), "APAC")


@query
def type_roku(spark, d):
    return staging.type_roku(view(spark, d, "raw_roku"), "AMER")


@query
def type_billing(spark, d):
    return staging.type_billing(view(spark, d, "raw_billing"))


@query
def staged_counts(spark, d):
    typed = staging.type_amazon(view(spark, d, "raw_amazon"), "EMEA")
    return files.staged_counts(typed)


def _fact(spark: SparkSession, d: str, provider: str, raw: str, region: str | None) -> DataFrame:
    rows = facts.to_fact(provider, staging.TYPERS[provider](view(spark, d, raw), region))
    numbers = ("pmt_channel_nr", "pmt_ra_status")
    return rows.select(*[F.col(c).cast("int").alias(c) if c in numbers else c for c in rows.columns])


@query
def fact_amazon(spark, d):
    return _fact(spark, d, "amazon", "raw_amazon", "EMEA")


@query
def fact_google(spark, d):
    return _fact(spark, d, "google", "raw_google", "APAC")


@query
def fact_roku(spark, d):
    return _fact(spark, d, "roku", "raw_roku", "AMER")


@query
def fact_billing(spark, d):
    return _fact(spark, d, "direct_billing", "raw_billing", None)


# Files


@query
def audit_current(spark, d):
    return files.current_audit(view(spark, d, "audit_log"))


@query
def audit_staged_counts(spark, d):
    typed = view(spark, d, "layer_typed")
    return files.with_staged_counts(view(spark, d, "load_audit"), typed)


@query
def mtd_superseded(spark, d):
    return files.all_superseded(view(spark, d, "load_audit"))


@query
def mtd_superseded_by_file(spark, d):
    audit = view(spark, d, "load_audit")
    return files.superseded_files(audit, "f_dplay_1995-02-18")


@query
def audit_after_supersession(spark, d):
    audit = view(spark, d, "load_audit")
    return files.mark_superseded(audit, files.all_superseded(audit))


@query
def fact_after_supersession(spark, d):
    gone = files.all_superseded(view(spark, d, "load_audit"))
    return facts.without_files(view(spark, d, "file_payments"), gone)


@query
def reload_idempotent(spark, d):
    again = view(spark, d, "file_redelivered")
    once = facts.replace_file(view(spark, d, "file_payments"), again, "f_dplay_1995-11-04")
    return facts.replace_file(once, again, "f_dplay_1995-11-04")


# SKUs


def _known(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "known_skus")


@query
def sku_classify(spark, d):
    return skus.classify_skus(
        view(spark, d, "payments"), view(spark, d, "apple_sales"), _known(spark, d)
    )


@query
def sku_promote(spark, d):
    return skus.promote_skus(
        _known(spark, d), view(spark, d, "payments"), view(spark, d, "apple_sales")
    )


@query
def new_sku_alert(spark, d):
    rows = view(spark, d, "payments").select(
        F.col("pmt_channel").alias("payment_provider"),
        F.col("vendor_sku").alias("sku_id"),
        "file_tx_region",
        F.col("utc_timestamp").alias("seen_at"),
    )
    return skus.new_sku_alert(rows, _known(spark, d))


# Accrual


def _lookups(spark: SparkSession, d: str) -> acc.AccrualLookups:
    return acc.AccrualLookups(
        fallback_country=view(spark, d, "fallback_country"),
        skus=view(spark, d, "accrual_skus"),
        exchange_rates=view(spark, d, "exchange_rates"),
        vat=view(spark, d, "vat"),
        commission=view(spark, d, "commission"),
    )


@query
def accrual_rows(spark, d):
    return acc.accrual(view(spark, d, "payments"), _lookups(spark, d), AS_OF)


@query
def accrual_daily(spark, d):
    return acc.daily_accrual(acc.accrual(view(spark, d, "payments"), _lookups(spark, d), AS_OF))


@query
def accrual_all_channels(spark, d):
    rows = acc.accrual(
        view(spark, d, "payments"), _lookups(spark, d), AS_OF, skus.STORE_CHANNELS
    )
    return acc.daily_accrual(rows)


@query
def fx_daily_avg(spark, d):
    return acc.daily_average_rates(view(spark, d, "rate_quotes"))


# Realms


def _by_realm(token: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = view(spark, d, "subscriptions")
        return (
            rows.where(realms.realm_filter(F.col("realm"), token))
            .groupBy("realm")
            .agg(F.count("*").alias("subscriptions"))
        )

    return run


for _name, _token in {"all": "%", "discovery": "$", "max": "^", "one": "dplay"}.items():
    add(f"realm_filter_{_name}", _by_realm(_token))


# Monitoring


def _monitor(spark: SparkSession, d: str) -> DataFrame:
    covered = monitor.collected_files(
        view(spark, d, "collection_audit"),
        view(spark, d, "load_audit"),
        view(spark, d, "monitor_config"),
        "amazon_sales",
        MONITOR_AS_OF,
    )
    return monitor.ingestion_monitor(
        covered,
        [view(spark, d, "layer_raw"), view(spark, d, "layer_raw_second")],
        view(spark, d, "layer_typed"),
        view(spark, d, "layer_fact"),
    )


@query
def monitor_files(spark, d):
    return _monitor(spark, d)


@query
def monitor_daily(spark, d):
    return monitor.monitor_daily(_monitor(spark, d))


@query
def monitor_master(spark, d):
    return monitor.master_rows(_monitor(spark, d), "amazon_sales")


@query
def monitor_master_stats(spark, d):
    return monitor.master_stats(monitor.master_rows(_monitor(spark, d), "amazon_sales"))


# Reconciliation


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "psp_payments"), view(spark, d, "charges")


MATCHERS = {name.lower(): matcher for name, matcher in recon.MATCHERS.items()}


def _match(name: str, levels: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        detail = MATCHERS[name](*_sides(spark, d))
        return recon.recon_levels(detail) if levels else detail

    return run


def _own(provider: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        charges = view(spark, d, "provider_charges")
        return recon.reconcile(provider, view(spark, d, "psp_payments"), charges)

    return run


for _name in recon.MATCHERS:
    add(f"recon_{_name.lower()}_own", _own(_name))


def _daily(provider: str) -> Query:
    """The match in three runs, each over the rows of its years and the rows left open before."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = scratch_tables(spark)
        payments, charges = _sides(spark, d)
        for first, last in ((1900, 1993), (1994, 1996), (1997, 2100)):
            reconcile_day(
                tables,
                provider,
                date(last, 12, 31),
                payments.where(F.year("utc_timestamp").between(first, last)),
                charges.where(F.year("charged_timestamp").between(first, last)),
            )
        return reconciled(tables, provider).drop("subscription_id")

    return run


add("recon_google_daily", _daily("Google"))


@query
def recon_amazon_crowded(spark, d):
    payments, charges = view(spark, d, "crowded_payments"), view(spark, d, "crowded_charges")
    return recon.match_amazon(payments, charges)


for _name in MATCHERS:
    add(f"recon_{_name}", _match(_name, levels=False))
    add(f"recon_{_name}_levels", _match(_name, levels=True))


@query
def recon_adyen_range(spark, d):
    detail = recon.match_adyen(*_sides(spark, d))
    return recon.recon_levels(recon.within_dates(detail, RECON_FROM, RECON_TO))


@query
def vendor_reference_lists(spark, d):
    return recon.vendor_reference_lists(view(spark, d, "charges"), size=5)


@query
def settlement_recon(spark, d):
    payments, charges = _sides(spark, d)
    return recon.settlement(payments, charges, view(spark, d, "exchange_rates"))


@query
def delay_percentiles(spark, d):
    rows = recon.settlement_delay(view(spark, d, "delay_payments"))
    names = ("p25", "p50", "p75", "p90", "p99")
    return rows.select(
        "merchant_account",
        "record_type",
        "records",
        *[F.round(n, 6).alias(n) for n in names],
    )


# Subscriptions


@query
def subs_trend(spark, d):
    return subscriptions.subscription_trend(view(spark, d, "subscriptions"))


@query
def subs_trend_discovery(spark, d):
    return subscriptions.subscription_trend(view(spark, d, "subscriptions"), "$")


@query
def active_subs(spark, d):
    return subscriptions.active_subscribers(view(spark, d, "subscription_history"))


@query
def active_subs_filtered(spark, d):
    return subscriptions.active_subscribers(
        view(spark, d, "subscription_history"),
        provider="Roku",
        realm="$",
        source_region="amer",
        status="%",
    )


def _stored_subscribers(spark: SparkSession, d: str, as_of: date, **choice) -> DataFrame:
    """Bitmaps of the day are written, and the count reads what was written."""
    tables = scratch_tables(spark)
    refresh_subscribers(tables, view(spark, d, "subscription_history"), as_of)
    return stored_subscribers(tables, as_of, **choice)


@query
def active_subs_bitmaps(spark, d):
    return _stored_subscribers(spark, d, date(2100, 1, 1))


@query
def active_subs_by_provider(spark, d):
    return _stored_subscribers(spark, d, date(2100, 1, 1), by=("payment_provider", "status"), status="%")


@query
def active_subs_max_by_region(spark, d):
    return _stored_subscribers(spark, d, SUBSCRIBERS_AS_OF, by=("source_region",), realm="^", status="%")


@query
def latest_subscriptions(spark, d):
    return subscriptions.latest_subscriptions(view(spark, d, "subscription_history"))


def _due(spark: SparkSession, d: str, **options) -> DataFrame:
    return subscriptions.due_not_billed(
        view(spark, d, "subscriptions"),
        view(spark, d, "price_plans"),
        view(spark, d, "billing_charges"),
        DUE_FROM,
        DUE_TO,
        **options,
    )


@query
def subs_due(spark, d):
    return _due(spark, d)


@query
def subs_due_no_rub(spark, d):
    return _due(spark, d, without_currency="RUB")


@query
def subs_due_apple(spark, d):
    return _due(spark, d, provider="Apple")


@query
def subs_due_bolt(spark, d):
    return _due(spark, d, staged_plans=view(spark, d, "staged_price_plans"))


@query
def subs_due_summary(spark, d):
    return subscriptions.due_summary(_due(spark, d))


@query
def affiliate_settled(spark, d):
    return subscriptions.affiliate_settled(
        view(spark, d, "settled_payments"), view(spark, d, "subscriptions")
    )


@query
def affiliate_share(spark, d):
    rows = subscriptions.affiliate_share(
        view(spark, d, "affiliate_payments"), view(spark, d, "contracts")
    )
    return subscriptions.affiliate_share_report(rows)


@query
def affiliate_share_rows(spark, d):
    return subscriptions.affiliate_share(
        view(spark, d, "affiliate_payments"), view(spark, d, "contracts")
    ).select(
        "affiliate",
        "transaction_type",
        "payment_period",
        "charged_timestamp",
        "start_timestamp",
        "months_since_start",
        "days_since_start",
        "revenue_share_multiplier",
        "affiliate_amount",
    )


# Lifecycle


@query
def sox_active(spark, d):
    return lifecycle.active_snapshot(view(spark, d, "lifecycle"))


@query
def sox_active_weekly(spark, d):
    days = [date.fromisoformat(x) for x in SNAPSHOTS]
    return lifecycle.active_snapshots(view(spark, d, "lifecycle"), days)


@query
def sox_active_weekly_pacific(spark, d):
    days = [date.fromisoformat(x) for x in SNAPSHOTS]
    return lifecycle.active_snapshots(view(spark, d, "lifecycle"), days, clock.PACIFIC)


REPORTS = {
    "sox_acquired": lifecycle.acquired_subscribers,
    "sox_renewals": lifecycle.renewals_summary,
    "sox_trials": lifecycle.trial_conversions,
    "sox_cancel": lifecycle.cancellations,
    "sox_failures": lifecycle.payment_failures,
    "sox_switches": lifecycle.plan_switches,
    "erp_extract": lifecycle.erp_extract,
}


def _report(name: str, zone: str | None) -> Query:
    return lambda spark, d: REPORTS[name](view(spark, d, "lifecycle"), zone)


for _name in REPORTS:
    add(_name, _report(_name, None))
    add(f"{_name}_pacific", _report(_name, clock.PACIFIC))


@query
def pacific_variant(spark, d):
    return lifecycle.dated(view(spark, d, "lifecycle"), clock.PACIFIC).select(
        "event_id", "event_epoch", "event_ts", "event_date"
    )


@query
def case_states_l1(spark, d):
    return subscriptions.state_counts(view(spark, d, "case_states"))


@query
def case_states_l2(spark, d):
    return subscriptions.state_records(
        view(spark, d, "case_states"), "IN_REVIEW", CASE_FROM, CASE_TO
    )


# Landing: the raw rows as lines of text, parsed again.


def _lines(spark: SparkSession, d: str, provider: str, name: str) -> DataFrame:
    raw = view(spark, d, name)
    fields = F.struct(*raw_widths(provider))
    if provider == "direct_billing":
        return raw.select(F.to_json(fields).alias("value"))
    sep = {"sep": landing.SEPARATORS[provider], "escape": '"'}
    return raw.select(F.to_csv(fields, sep).alias("value"))


@query
def land_apple(spark, d):
    return staging.clean_raw(landing.parse_text(_lines(spark, d, "apple", "raw_apple"), "apple"), "apple")


@query
def land_amazon(spark, d):
    return staging.clean_raw(landing.parse_text(_lines(spark, d, "amazon", "raw_amazon"), "amazon"), "amazon")


@query
def land_direct_billing(spark, d):
    rows = landing.parse_json(_lines(spark, d, "direct_billing", "raw_billing"))
    return staging.clean_raw(rows, "direct_billing")


@query
def land_rejects(spark, d):
    """Every thirteenth order's lines lose their first separator; others may lack a required field."""
    order = F.regexp_extract("value", ",t([0-9]+)-", 1).cast("bigint")
    broken = F.when(order % 13 == 0, F.regexp_replace("value", "^([^,]*),", "$1")).otherwise(F.col("value"))
    lines = _lines(spark, d, "amazon", "raw_amazon").select(broken.alias("value"))
    rows = landing.with_required(landing.parse_text(lines, "amazon"), ["receipt_id"])
    return rows.groupBy(F.coalesce("_reason", F.lit("landed")).alias("reason")).agg(F.count("*").alias("lines"))


# Loads of files from end to end


@query
def load_audit(spark, d):
    columns = ("file_tx_id", "data_source", "data_file", "status", "record_count_staging")
    return loaded(spark, d).audit().select(*columns)


@query
def load_payments(spark, d):
    columns = ("file_tx_id", "transaction_id", "main_amount", "utc_timestamp", "record_key")
    return loaded(spark, d).read("payments").select(*columns)


@query
def load_closed_files(spark, d):
    """What the closings hold, by provider file, and whether it is in force."""
    tables = loaded(spark, d)
    closed = tables.spark.table(tables.name("payments_closed"))
    counted = closed.groupBy("file_tx_id", "stored").agg(F.count("*").alias("closed_rows"))
    sets = tables.file_sets().select("file_tx_id", "stored", F.lit(True).alias("found"))
    return counted.join(sets, ["file_tx_id", "stored"], "left").select(
        "file_tx_id", "closed_rows", F.coalesce("found", F.lit(False)).alias("in_force")
    )


@query
def load_sku_sales(spark, d):
    return loaded(spark, d).sku_sales().drop("generation")


@query
def load_skus(spark, d):
    columns = ("payment_provider", "sku_id", "file_tx_region", "included_in_accrual_yn")
    return loaded(spark, d).skus().select(*columns)


@query
def load_master(spark, d):
    counts = ("raw_transaction_count", "final_transaction_count", "fact_transaction_count")
    return loaded(spark, d).read("ingestion_master").select("mv_id", "file_tx_id", "load_status", *counts)


@query
def load_monitor_stamp(spark, d):
    columns = ("mv_id", "mv_status", "mv_min_date", "mv_max_date", "mv_row_count")
    return loaded(spark, d).monitor_config().select(*columns)
