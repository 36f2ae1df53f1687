"""Subscription lifecycle reports over purchase events, in UTC or another zone.

Events carry epoch seconds: event_id, subscription_id, event_epoch, kind, product_plan,
plan_rank, vod_type, price_plan, promo, billing_anchor, reason, attempt_result, amount, currency,
invoice_id, term_end_epoch. Kinds: TRIAL, ACQUIRE, RENEWAL, SWITCH, CANCEL, PAYMENT.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.clock import from_epoch, in_zone
from tillroll.functions.money import TOTAL
from tillroll.functions.text import by_value
from tillroll.operators.ordered import latest, position, previous, running_total

ATTEMPTS = 10

# The class of each cancellation reason, and the classes that count as voluntary.
CANCELLATION_CLASSES = {
    "HARD_DECLINE": "hard decline",
    "SOFT_DECLINE": "soft decline",
    "REFUND": "refund",
    "AUTO_RENEW_OFF": "auto-renew-off",
    "CHARGEBACK": "chargeback",
}
VOLUNTARY = ("AUTO_RENEW_OFF", "REFUND")


def dated(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Events with their time, in UTC unless a zone is named, and their day there."""
    utc = from_epoch(F.col("event_epoch"))
    stamp = utc if zone is None else in_zone(utc, zone)
    return events.withColumn("event_ts", stamp).withColumn(
        "event_date", F.col("event_ts").cast("date")
    )


def _when(test: Column) -> Column:
    return F.count(F.when(test, 1))


def active_snapshot(events: DataFrame) -> DataFrame:
    """Subscriptions whose last event is not a cancellation, by plan, VOD type, price plan, promo
    and billing anchor."""
    newest = [F.col("event_epoch").desc(), F.col("event_id").desc()]
    last = latest(events, ["subscription_id"], newest)
    return (
        last.where(F.col("kind") != "CANCEL")
        .groupBy("product_plan", "vod_type", "price_plan", "promo", "billing_anchor")
        .agg(F.count("*").alias("active_subscribers"))
    )


SNAPSHOT_KEYS = ("product_plan", "vod_type", "price_plan", "promo", "billing_anchor")


def state_days(events: DataFrame, zone: str | None = None) -> DataFrame:
    """The days on which each event is its subscription's last: from_day to to_day, both included and NULL
    while no later day has an event. Events that another one of the same day follows have none."""
    turned = dated(events, zone).withColumns({"_epoch": -F.col("event_epoch"), "_id": -F.col("event_id")})
    followed = previous(
        turned,
        ["subscription_id"],
        ["_epoch", "_id"],
        F.floor(F.col("_epoch") / 3600),
        {"event_date": "_next"},
    )
    return (
        followed.where(F.col("_next").isNull() | (F.col("_next") > F.col("event_date")))
        .withColumn("to_day", F.date_sub("_next", 1))
        .withColumnRenamed("event_date", "from_day")
        .drop("_epoch", "_id", "_next")
    )


def active_snapshots(events: DataFrame, days: Sequence[date], zone: str | None = None) -> DataFrame:
    """active_snapshot as of the end of each of these days.

    A state counts from its first day and no longer counts after its last: these gains and losses are summed
    per group and snapshot that they first show in, and a running total of the sums is the snapshot. So a state
    of many years is two numbers, not a row for every day, and the whole history is read once for all days.
    """
    wanted = F.array(*[F.lit(d) for d in sorted(set(days))])
    active = state_days(events, zone).where(F.col("kind") != "CANCEL")
    changes = active.select(
        *SNAPSHOT_KEYS,
        F.explode(
            F.array(
                F.struct(F.col("from_day").alias("day"), F.lit(1).alias("n")),
                F.struct(F.date_add("to_day", 1).alias("day"), F.lit(-1).alias("n")),
            )
        ).alias("_x"),
    ).where(F.col("_x.day").isNotNull())
    shown = F.array_min(F.filter(wanted, lambda d: d >= F.col("_x.day")))
    summed = (
        changes.withColumn("snapshot_date", shown)
        .where(F.col("snapshot_date").isNotNull())
        .groupBy(*SNAPSHOT_KEYS, "snapshot_date")
        .agg(F.sum("_x.n").alias("_n"))
    )
    later = F.explode(F.filter(wanted, lambda d: d >= F.col("_first")))
    groups = summed.groupBy(*SNAPSHOT_KEYS).agg(F.min("snapshot_date").alias("_first"))
    every = groups.select(*SNAPSHOT_KEYS, later.alias("snapshot_date")).withColumn("_n", F.lit(0).cast("bigint"))
    total = F.sum(F.sum("_n")).over(Window.partitionBy(*SNAPSHOT_KEYS).orderBy("snapshot_date"))
    counted = summed.unionByName(every).groupBy(*SNAPSHOT_KEYS, "snapshot_date").agg(total.alias("active_subscribers"))
    return counted.where(F.col("active_subscribers") > 0).select("snapshot_date", *SNAPSHOT_KEYS, "active_subscribers")


def with_previous(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Events with values of the subscription's event before."""
    return previous(
        events,
        ["subscription_id"],
        ["event_epoch", "event_id"],
        F.floor(F.col("event_epoch") / 3600),
        columns,
    )


def acquired_subscribers(events: DataFrame, zone: str | None = None) -> DataFrame:
    """New subscriptions per day and plan: first ones, returns as an upgrade or a downgrade, and
    returns after the earlier term had truly expired."""
    stamped = with_previous(
        events, {"kind": "before_kind", "plan_rank": "before_rank", "term_end_epoch": "before_end"}
    )
    expired = F.col("before_kind").isNotNull() & (F.col("before_end") < F.col("event_epoch"))
    running = F.col("before_kind").isNotNull() & ~expired
    return (
        dated(stamped.where(F.col("kind") == "ACQUIRE"), zone)
        .groupBy("event_date", "product_plan")
        .agg(
            F.count("*").alias("acquired"),
            _when(F.col("before_kind").isNull()).alias("first_time"),
            _when(expired).alias("true_expire"),
            _when(running & (F.col("plan_rank") > F.col("before_rank"))).alias("upgrade"),
            _when(running & (F.col("plan_rank") < F.col("before_rank"))).alias("downgrade"),
        )
    )


def renewals_summary(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Renewals, voluntary and involuntary churn, and switches per day and plan."""
    kind = F.col("kind")
    cancelled = kind == "CANCEL"
    voluntary = F.coalesce(F.col("reason").isin(*VOLUNTARY), F.lit(False))
    return (
        dated(events.where(kind.isin("RENEWAL", "CANCEL", "SWITCH")), zone)
        .groupBy(F.col("event_date").alias("invoice_date"), "product_plan")
        .agg(
            _when(kind == "RENEWAL").alias("renewals"),
            _when(cancelled & voluntary).alias("voluntary_churn"),
            _when(cancelled & ~voluntary).alias("involuntary_churn"),
            _when(kind == "SWITCH").alias("switches"),
        )
    )


def trial_conversions(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Trials by the day they began: converted if a paid event follows before the subscription's next
    trial, cancelled if a cancellation does and no paid one, else still open.

    Events are numbered by the trials up to them, in order of time and id, and each trial's events
    shrink to a few moments; the count runs over cells of 30 days, so a hot subscription is spread.
    """
    at, kind = F.col("event_epoch"), F.col("kind")
    trial = F.when(kind == "TRIAL", 1).otherwise(0).cast("bigint")
    cells = F.floor(at / (30 * 86400))
    numbered = running_total(
        events.where(kind.isin("TRIAL", "ACQUIRE", "RENEWAL", "CANCEL")),
        ["subscription_id"], ["event_epoch", "event_id"], trial, cells, "_trial",
    )
    moments = numbered.groupBy("subscription_id", "_trial").agg(
        F.min(F.when(kind == "TRIAL", at)).alias("event_epoch"),
        F.max(F.when(kind.isin("ACQUIRE", "RENEWAL"), at)).alias("_paid"),
        F.max(F.when(kind == "CANCEL", at)).alias("_cancelled"),
    )
    start = F.col("event_epoch")
    converted = F.coalesce(F.col("_paid") > start, F.lit(False))
    cancelled = ~converted & F.coalesce(F.col("_cancelled") > start, F.lit(False))
    return (
        dated(moments.where(start.isNotNull()), zone)
        .groupBy(F.col("event_date").alias("signup_date"))
        .agg(
            F.count("*").alias("signups"),
            _when(converted).alias("conversions"),
            _when(cancelled).alias("cancellations"),
            _when(~converted & ~cancelled).alias("open_trials"),
        )
    )


def cancellations(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Cancellations per day, plan and class of reason."""
    reason = by_value(F.col("reason"), CANCELLATION_CLASSES, default=F.lit("other"))
    return (
        dated(events.where(F.col("kind") == "CANCEL"), zone)
        .groupBy("event_date", "product_plan", reason.alias("cancellation_class"))
        .agg(F.count("*").alias("cancellations"))
    )


def payment_failures(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Failed and successful payment attempts by invoice day, plan and attempt number.

    Attempts 1 to 10 have columns of their own; any later ones are counted together.
    """
    tries = dated(
        events.where((F.col("kind") == "PAYMENT") & F.col("invoice_id").isNotNull()), zone
    )
    hour = F.floor(F.col("event_epoch") / 3600)
    numbered = position(tries, ["invoice_id"], ["event_epoch", "event_id"], hour, "attempt")
    first = numbered.withColumn(
        "_slot", F.least(F.col("attempt"), F.lit(ATTEMPTS + 1)).cast("int")
    )
    columns = []
    for result in ("SUCCESS", "FAILURE"):
        for n in range(1, ATTEMPTS + 2):
            name = f"{result.lower()}_{n if n <= ATTEMPTS else 'later'}"
            hit = (F.col("_slot") == n) & (F.col("attempt_result") == result)
            columns.append(_when(hit).alias(name))
    return first.groupBy(F.col("event_date").alias("invoice_date"), "product_plan").agg(
        F.count("*").alias("attempts"), *columns
    )


def plan_switches(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Moves from plan to plan per day, with their direction."""
    moved = with_previous(events, {"product_plan": "from_plan", "plan_rank": "from_rank"}).where(
        (F.col("kind") == "SWITCH") & (F.col("from_plan") != F.col("product_plan"))
    )
    direction = (
        F.when(F.col("plan_rank") > F.col("from_rank"), "upgrade")
        .when(F.col("plan_rank") < F.col("from_rank"), "downgrade")
        .otherwise("sidegrade")
    )
    return (
        dated(moved, zone)
        .groupBy(
            "event_date",
            "from_plan",
            F.col("product_plan").alias("to_plan"),
            direction.alias("direction"),
        )
        .agg(F.count("*").alias("switches"))
    )


def erp_extract(events: DataFrame, zone: str | None = None) -> DataFrame:
    """Revenue lines for the ERP system: one per day, plan and currency, all fields as text."""
    lines = (
        dated(events.where(F.col("kind").isin("ACQUIRE", "RENEWAL")), zone)
        .groupBy("event_date", "product_plan", "currency")
        .agg(F.count("*").alias("_lines"), F.sum("amount").cast(TOTAL).alias("_amount"))
    )
    return lines.select(
        F.date_format("event_date", "dd-MM-yyyy").alias("GL_DATE"),
        F.concat_ws("-", F.lit("SUBS"), F.upper("product_plan")).alias("LINE_TYPE"),
        F.col("currency").alias("CURRENCY_CODE"),
        F.col("_lines").cast("string").alias("QUANTITY"),
        F.col("_amount").cast("decimal(30,2)").cast("string").alias("AMOUNT"),
    )
