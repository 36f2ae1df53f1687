"""Subscription reports: trends, active counts, billing due and affiliate revenue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.clock import month_of, months_since
from tillroll.functions.money import MONEY, RATE, TOTAL
from tillroll.functions.realms import realm_filter, subscriber_id, wildcard
from tillroll.operators.lookups import unique_lookup
from tillroll.operators.ordered import latest

BILLING_TYPES = ("RECURRING", "FIRST")


def subscription_trend(subscriptions: DataFrame, realm: str = "%") -> DataFrame:
    """Starts and terminations per month, provider and realm, against the month before.

    Each kind is counted first and the two counts are united, so the month step runs on one row
    per month and group. From a kind's first month to the last month of its provider and realm, of
    either kind, every month has a row; one without events counts as zero, so a last fall to zero shows.
    Change from zero has no percentage.
    """
    rows = subscriptions.where(realm_filter(F.col("realm"), realm))
    kinds = {"START": "start_timestamp", "TERMINATION": "termination_timestamp"}
    counted = None
    for kind, column in kinds.items():
        one = (
            rows.where(F.col(column).isNotNull())
            .groupBy("payment_provider", "realm", month_of(F.col(column)).alias("month"))
            .agg(F.count("*").alias("current_month"))
            .withColumn("kind", F.lit(kind))
        )
        counted = one if counted is None else counted.unionByName(one)
    group = ["kind", "payment_provider", "realm"]
    of_both = Window.partitionBy("payment_provider", "realm")  # two rows
    spans = (
        counted.groupBy(*group)
        .agg(F.min("month").alias("_first"), F.max("month").alias("_end"))
        .withColumn("_last", F.max("_end").over(of_both))
    )
    step = F.expr("interval 1 month")
    months = spans.select(*group, F.explode(F.sequence("_first", "_last", step)).alias("month"))
    zeros = months.withColumn("current_month", F.lit(0).cast("bigint"))
    counted = counted.unionByName(zeros).groupBy(*group, "month").agg(F.sum("current_month").alias("current_month"))
    by_month = Window.partitionBy("kind", "payment_provider", "realm").orderBy("month")
    follows = F.lag("month").over(by_month) == F.add_months("month", -1)
    prior = F.when(follows, F.lag("current_month").over(by_month)).otherwise(F.lit(0))
    change = F.col("current_month") - F.col("prior_month")
    hundred = F.lit(100).cast("decimal(3,0)")
    return counted.withColumn("prior_month", prior.cast("bigint")).select(
        "kind",
        "payment_provider",
        "realm",
        "month",
        "current_month",
        "prior_month",
        F.round(change * hundred / F.nullif("prior_month", F.lit(0)), 2)
        .cast("double")
        .alias("kpi_value"),
        change.alias("trend_value"),
    )


def latest_subscriptions(history: DataFrame) -> DataFrame:
    """The last row of each subscription."""
    newest = [F.col("updated_timestamp").desc(), F.col("row_id").desc()]
    return latest(history, ["subscription_id"], newest)


def active_subscribers(
    history: DataFrame,
    provider: str = "%",
    realm: str = "%",
    source_region: str = "%",
    status: str = "ACTIVE",
) -> DataFrame:
    """Subscribers by provider, realm and region, each realm counted by its own kind of id."""
    rows = latest_subscriptions(history).where(
        wildcard(F.col("payment_provider"), provider)
        & realm_filter(F.col("realm"), realm)
        & wildcard(F.col("source_region"), source_region)
        & wildcard(F.col("status"), status)
    )
    who = subscriber_id(F.col("realm"), F.col("subscription_id"), F.col("global_subscription_id"))
    return rows.groupBy("payment_provider", "realm", "source_region", "status").agg(
        F.countDistinct(who).alias("subscribers"), F.count("*").alias("subscriptions")
    )


def due_not_billed(
    subscriptions: DataFrame,
    plans: DataFrame,
    charges: DataFrame,
    due_from: date,
    due_to: date,
    grace_days: int = 1,
    without_currency: str | None = None,
    provider: str = "%",
    staged_plans: DataFrame | None = None,
) -> DataFrame:
    """Active subscriptions due in a range with no first or recurring charge on the due day or in
    the `grace_days` after it.

    `without_currency` leaves out plans of that currency, `provider` keeps one, and `staged_plans`
    (price_plan_id, payment_period, provider) take the place of the plan's own period and provider.
    """
    plan = plans.select(
        "price_plan_id",
        "payment_period",
        F.col("provider").alias("plan_provider"),
        F.col("currency").alias("plan_currency"),
        F.col("amount").alias("plan_amount"),
    )
    plan = unique_lookup(plan, ["price_plan_id"], "price plans")
    if staged_plans is not None:
        staged = unique_lookup(
            staged_plans.select("price_plan_id", "payment_period", "provider"),
            ["price_plan_id"],
            "staged price plans",
        )
        plan = plan.drop("payment_period", "plan_provider").join(
            staged.withColumnRenamed("provider", "plan_provider"), "price_plan_id"
        )
    due_date = F.col("next_due_date")
    due = subscriptions.where(
        (F.col("status") == "ACTIVE")
        & due_date.between(F.lit(due_from), F.lit(due_to))
        & wildcard(F.col("payment_provider"), provider)
    ).join(plan, "price_plan_id")
    if without_currency is not None:
        due = due.where(F.col("plan_currency") != without_currency)
    # A charge answers for the due days up to `grace_days` before it: a fixed few rows each.
    answered = (
        charges.where(F.col("transaction_type").isin(*BILLING_TYPES))
        .select("subscription_id", F.col("charged_timestamp").cast("date").alias("_charged"))
        .distinct()
        .select(
            "subscription_id",
            F.explode(F.array(*[F.date_sub("_charged", n) for n in range(grace_days + 1)])).alias(
                "next_due_date"
            ),
        )
    )
    return due.join(answered, ["subscription_id", "next_due_date"], "left_anti").select(
        "subscription_id",
        "realm",
        "payment_provider",
        "price_plan_id",
        "payment_period",
        "plan_provider",
        "plan_currency",
        "plan_amount",
        "next_due_date",
    )


def due_summary(due: DataFrame) -> DataFrame:
    """Subscriptions due and not billed per due day, provider and period."""
    return due.groupBy("next_due_date", "payment_provider", "payment_period").agg(
        F.count("*").alias("not_billed"), F.sum("plan_amount").cast(TOTAL).alias("plan_amount")
    )


def affiliate_settled(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Settled payments of subscriptions that a device maker brought in, by maker and month.

    Payments shrink to one row per subscription, month and currency before the join.
    """
    settled = (
        payments.where(F.col("record_type") == "Settled")
        .groupBy(
            "subscription_id", month_of(F.col("utc_timestamp")).alias("settled_month"), "currency"
        )
        .agg(F.count("*").alias("_payments"), F.sum("amount").alias("_amount"))
    )
    brought = subscriptions.where(F.col("affiliate").isNotNull()).select(
        "subscription_id", "affiliate"
    )
    origin = unique_lookup(brought, ["subscription_id"], "affiliate subscriptions")
    return (
        settled.join(origin, "subscription_id")
        .groupBy("affiliate", "settled_month", "currency")
        .agg(
            F.sum("_payments").alias("settled_payments"),
            F.countDistinct("subscription_id").alias("subscriptions"),
            F.sum("_amount").cast(TOTAL).alias("settled_amount"),
        )
    )


def revenue_share_multiplier() -> Column:
    """The share of a payment that goes to the affiliate.

    Nothing once the cap in months is reached. In the last month before it, a monthly upgrade earns
    the part of its billing month that lies before the cap, and a yearly payment that starts there
    the part of its year. Everything else earns the whole share.
    """
    months, cap = F.col("months_since_start"), F.col("payment_cap_months")
    left = F.col("max_days_in_payment_cap") - F.col("days_since_start")
    start = F.col("original_chg_date")
    month_days = F.datediff(F.add_months(start, 1), start)
    year_days = F.datediff(F.add_months(start, 12), start)
    share = F.col("revenue_share").cast(RATE)
    in_last_month = (months == cap - 1) & (F.col("transaction_type") == "UPGRADE")

    def part(days: Column) -> Column:
        return (share * left / days).cast(RATE)

    return (
        F.when(months >= cap, F.lit(0).cast(RATE))
        .when(in_last_month & (F.col("payment_period") == "MONTH"), part(month_days))
        .when(in_last_month & (F.col("payment_period") == "YEAR"), part(year_days))
        .otherwise(share)
    )


def affiliate_share(payments: DataFrame, contracts: DataFrame) -> DataFrame:
    """Affiliate payments with their share of the revenue.

    Contracts: affiliate (key), payment_cap_months, max_days_in_payment_cap, revenue_share.
    """
    terms = unique_lookup(contracts, ["affiliate"], "affiliate contracts")
    at, start = F.col("charged_timestamp"), F.col("start_timestamp")
    rows = (
        payments.where(F.col("affiliate").isNotNull())
        .join(terms, "affiliate")
        .withColumn("months_since_start", months_since(start, at))
        .withColumn("days_since_start", F.datediff(at.cast("date"), start.cast("date")))
        .withColumn("original_chg_date", at.cast("date"))
        .withColumn("revenue_share_multiplier", revenue_share_multiplier())
    )
    earned = F.col("amount").cast(MONEY) * F.col("revenue_share_multiplier").cast("decimal(14,10)")
    return rows.withColumn("affiliate_amount", earned.cast(MONEY))


def affiliate_share_report(shares: DataFrame) -> DataFrame:
    """Affiliate revenue by maker, transaction type, period and months since the start."""
    return shares.groupBy(
        "affiliate", "transaction_type", "payment_period", "months_since_start"
    ).agg(
        F.count("*").alias("payments"),
        F.sum("amount").cast(TOTAL).alias("amount"),
        F.sum("affiliate_amount").cast(TOTAL).alias("affiliate_amount"),
    )


def state_counts(states: DataFrame) -> DataFrame:
    """Level 1 of a case dashboard: records by state and day."""
    return states.groupBy("state", F.col("state_timestamp").cast("date").alias("state_date")).agg(
        F.count("*").alias("records")
    )


def state_records(states: DataFrame, state: str, day_from: date, day_to: date) -> DataFrame:
    """Level 2: the records in one state over some days."""
    day = F.col("state_timestamp").cast("date")
    return states.where(
        (F.col("state") == state)
        & (F.col("state_timestamp") >= F.lit(day_from).cast("timestamp_ntz"))
        & (F.col("state_timestamp") < F.date_add(F.lit(day_to), 1).cast("timestamp_ntz"))
    ).select("record_id", "state", "state_timestamp", day.alias("state_date"))
