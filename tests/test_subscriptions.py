import random
from collections import Counter
from datetime import date, datetime, timezone
from decimal import Decimal as D
from zoneinfo import ZoneInfo

import pytest

from tillroll.functions.clock import PACIFIC
from tillroll.operators import lifecycle
from tillroll.operators.bitmaps import subscriber_bitmaps
from tillroll.operators.lifecycle import active_snapshots
from tillroll.operators.subscriptions import (
    active_subscribers,
    affiliate_share,
    due_not_billed,
    state_records,
    subscription_trend,
)
from tillroll.plans.refresh import refresh_subscribers, stored_subscribers
from tillroll.sources.extract import write_csv_extract

HISTORY = (
    "row_id int, subscription_id string, global_subscription_id string, realm string, "
    "source_region string, payment_provider string, status string, updated_timestamp timestamp_ntz"
)


def test_trend_counts_a_missing_month_as_zero(spark):
    starts = ["2024-01-05", "2024-01-09", "2024-02-01", "2024-04-30", "2024-04-01", "2024-04-02"]
    rows = [("Roku", "go", datetime.fromisoformat(s), None) for s in starts]
    df = spark.createDataFrame(
        rows,
        "payment_provider string, realm string, start_timestamp timestamp_ntz, "
        "termination_timestamp timestamp_ntz",
    )
    got = {
        r.month.month: (r.current_month, r.prior_month, r.kpi_value, r.trend_value)
        for r in subscription_trend(df).collect()
    }
    assert got == {
        1: (2, 0, None, 2), 2: (1, 2, -50.0, -1), 3: (0, 1, -100.0, -1), 4: (3, 0, None, 3)
    }


def test_a_last_fall_to_zero_is_reported(spark):
    rows = [("Roku", "go", datetime(2024, 1, 5), datetime(2024, 4, 9)), ("Roku", "dplay", datetime(2024, 1, 5), None)]
    df = spark.createDataFrame(
        rows,
        "payment_provider string, realm string, start_timestamp timestamp_ntz, "
        "termination_timestamp timestamp_ntz",
    )
    got = {
        (r.realm, r.kind, r.month.month): (r.current_month, r.kpi_value)
        for r in subscription_trend(df).collect()
    }
    assert got == {
        ("go", "START", 1): (1, None), ("go", "START", 2): (0, -100.0), ("go", "START", 3): (0, None),
        ("go", "START", 4): (0, None), ("go", "TERMINATION", 4): (1, None), ("dplay", "START", 1): (1, None),
    }


@pytest.mark.parametrize("zone", [None, "America/Los_Angeles"])
def test_snapshots_of_any_day(spark, zone):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        sub = 1 if n % 3 == 0 else rng.randint(2, 25)
        epoch = 1_704_067_200 + rng.randrange(40) * 21_600 + rng.choice([0, 1, 1])
        kind = rng.choice(["RENEWAL", "CANCEL", "SWITCH"])
        rows.append((n, sub, epoch, kind, rng.choice(["basic", None]), "svod", "p", "none", rng.randint(1, 2)))
    events = spark.createDataFrame(
        rows,
        "event_id bigint, subscription_id bigint, event_epoch bigint, kind string, product_plan string, "
        "vod_type string, price_plan string, promo string, billing_anchor int",
    ).repartition(3)
    days = [date(2023, 12, 1), date(2024, 1, 1), date(2024, 1, 4), date(2024, 1, 5), date(2024, 6, 30), date(2024, 1, 4)]
    got = Counter()
    for r in active_snapshots(events, days, zone).collect():
        got[r.snapshot_date, r.product_plan, r.billing_anchor] += r.active_subscribers
    want = Counter()
    for day in set(days):
        last = {}
        for e in sorted(rows, key=lambda e: (e[2], e[0])):
            at = datetime.fromtimestamp(e[2], timezone.utc)
            if zone:
                at = at.astimezone(ZoneInfo(zone))
            if at.date() <= day:
                last[e[1]] = e
        want.update((day, e[4], e[8]) for e in last.values() if e[3] != "CANCEL")
    assert got == want and len({k[0] for k in want}) >= 3


def test_active_subscribers_count_the_last_state_by_the_realms_id(spark):
    def row(n, sub, realm, status, day, who="g1"):
        return (n, sub, who, realm, "amer", "Roku", status, datetime(2024, 1, day))

    df = spark.createDataFrame(
        [
            row(1, "s1", "go", "ACTIVE", 1), row(2, "s1", "go", "TERMINATED", 2),
            row(3, "s2", "go", "TERMINATED", 1), row(4, "s2", "go", "ACTIVE", 1),
            row(5, "s3", "go", "ACTIVE", 1), row(6, "b1", "bolt", "ACTIVE", 1),
            row(7, "b2", "bolt", "ACTIVE", 1), row(8, "o1", "other", "ACTIVE", 1),
        ],
        HISTORY,
    )
    got = {r.realm: (r.subscribers, r.subscriptions) for r in active_subscribers(df).collect()}
    assert got == {"go": (2, 2), "bolt": (1, 2), "other": (0, 1)}
    only = active_subscribers(df, realm="^").collect()
    assert [r.realm for r in only] == ["bolt"]


def test_bitmaps_count_as_sets_do(spark, tables):
    rng = random.Random(8)
    realms = ["go", "dplay", "bolt", "streaming", "other"]
    rows = [
        (n, rng.choice([f"s{rng.randint(1, 90)}", "hot"]), rng.choice([f"s{rng.randint(1, 30)}", "hot", None]),
         rng.choice(realms), rng.choice(["amer", None]), rng.choice(["Roku", "Apple"]), rng.choice(["ACTIVE", "GONE"]),
         datetime(2024, 1, rng.randint(1, 28)))
        for n in range(600)
    ]
    history = spark.createDataFrame(rows, HISTORY)
    for day in (10, 28, 28):  # a day twice
        refresh_subscribers(tables, history, date(2024, 1, day))
    tokens = {"%": realms, "$": ["go", "dplay"], "^": ["bolt", "streaming"], "go": ["go"]}
    for day, by, token in ((10, (), "%"), (28, (), "$"), (28, ("realm", "status"), "%"), (28, ("source_region",), "^"), (10, ("payment_provider",), "go")):
        last = {}
        for r in sorted(rows, key=lambda r: (r[7], r[0])):
            if r[7] <= datetime(2024, 1, day):
                last[r[1]] = r
        names = {"payment_provider": 5, "realm": 3, "source_region": 4, "status": 6}
        sets, want = {(): set()} if not by else {}, Counter()
        for r in last.values():
            if r[3] in tokens[token]:
                key = tuple(r[names[b]] for b in by)
                who = (1, r[1]) if r[3] in tokens["$"] else (2, r[2]) if r[3] in tokens["^"] and r[2] else None
                sets.setdefault(key, set()).update({who} - {None})
                want[key] += 1
        found = stored_subscribers(tables, date(2024, 1, day), by=by, realm=token, status="%").collect()
        assert {tuple(r[b] for b in by): (r.subscribers, r.subscriptions) for r in found} == {k: (len(s), want[k]) for k, s in sets.items()}
    assert stored_subscribers(tables, date(2024, 1, 10), by=(), realm="none").first() == (0, 0)
    assert subscriber_bitmaps(history.where("false")).count() == 0
    with pytest.raises(ValueError, match="some of"):
        stored_subscribers(tables, date(2024, 1, 10), by=("bucket",))


def test_due_and_not_billed(spark):
    subs = spark.createDataFrame(
        [(n, "go", "Roku", "ACTIVE" if n != 5 else "PAUSED", "p", date(2024, 1, d))
         for n, d in ((1, 10), (2, 10), (3, 10), (4, 10), (5, 10), (6, 31), (7, 1))],
        "subscription_id int, realm string, payment_provider string, status string, "
        "price_plan_id string, next_due_date date",
    )
    plans = spark.createDataFrame(
        [("p", "MONTH", "USD", "Adyen", D("9.99"))],
        "price_plan_id string, payment_period string, currency string, provider string, "
        "amount decimal(20,6)",
    )
    charges = spark.createDataFrame(
        [(1, "RECURRING", datetime(2024, 1, 10, 9)), (2, "FIRST", datetime(2024, 1, 11, 23)),
         (3, "RECURRING", datetime(2024, 1, 12)), (4, "REFUND", datetime(2024, 1, 10)),
         (7, "RECURRING", datetime(2023, 12, 31))],
        "subscription_id int, transaction_type string, charged_timestamp timestamp_ntz",
    )
    due = due_not_billed(subs, plans, charges, date(2024, 1, 1), date(2024, 1, 30))
    assert sorted(r.subscription_id for r in due.collect()) == [3, 4, 7]
    exact = due_not_billed(subs, plans, charges, date(2024, 1, 1), date(2024, 1, 30), grace_days=0)
    assert sorted(r.subscription_id for r in exact.collect()) == [2, 3, 4, 7]
    none = due_not_billed(
        subs, plans, charges, date(2024, 1, 1), date(2024, 1, 30), without_currency="USD"
    )
    assert none.count() == 0


@pytest.mark.parametrize(
    ("start", "at", "kind", "period", "share"),
    [
        ("2024-01-15", "2024-04-15", "UPGRADE", "MONTH", "0"),
        ("2024-01-15", "2024-05-15", "RECURRING", "MONTH", "0"),
        # 91 - 70 days are left of a billing month of 31.
        ("2024-01-15", "2024-03-25", "UPGRADE", "MONTH", "0.1354838710"),
        ("2024-01-15", "2024-03-25", "UPGRADE", "YEAR", "0.0115068493"),
        ("2024-01-15", "2024-03-25", "RECURRING", "MONTH", "0.2"),
        ("2024-01-15", "2024-02-20", "UPGRADE", "MONTH", "0.2"),
    ],
)
def test_affiliate_share(spark, start, at, kind, period, share):
    payments = spark.createDataFrame(
        [("SONY", kind, period, D("100"), datetime.fromisoformat(at),
          datetime.fromisoformat(start))],
        "affiliate string, transaction_type string, payment_period string, "
        "amount decimal(20,6), charged_timestamp timestamp_ntz, start_timestamp timestamp_ntz",
    )
    contracts = spark.createDataFrame(
        [("SONY", 3, 91, D("0.2"))],
        "affiliate string, payment_cap_months int, max_days_in_payment_cap int, "
        "revenue_share decimal(20,10)",
    )
    (row,) = affiliate_share(payments, contracts).collect()
    assert row.revenue_share_multiplier == D(share)


def test_case_records_include_the_last_day(spark):
    rows = [(n, "OPEN", datetime(2024, 1, d, h)) for n, d, h in ((1, 4, 23), (2, 5, 0), (3, 6, 23), (4, 7, 0))]
    df = spark.createDataFrame(rows, "record_id int, state string, state_timestamp timestamp_ntz")
    got = state_records(df, "OPEN", date(2024, 1, 5), date(2024, 1, 6)).collect()
    assert sorted(r.record_id for r in got) == [2, 3]


EVENT = (
    "event_id bigint, subscription_id bigint, event_epoch bigint, kind string, "
    "product_plan string, plan_rank int, vod_type string, price_plan string, promo string, "
    "billing_anchor int, reason string, attempt_result string, amount decimal(20,6), "
    "currency string, invoice_id string, term_end_epoch bigint"
)
HOUR = 3600


def event(n, sub, hour, kind, plan="basic", rank=1, reason=None, result=None, invoice=None, end=0):
    return (n, sub, hour * HOUR, kind, plan, rank, "svod", "p0", "none", 1, reason, result, D("5"),
            "USD", invoice, end * HOUR)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def test_acquired_by_what_came_before(spark):
    df = events(
        spark,
        event(1, 1, 1, "ACQUIRE"),
        event(2, 2, 1, "CANCEL", end=5), event(3, 2, 50, "ACQUIRE"),
        event(4, 3, 1, "CANCEL", rank=1, end=99), event(5, 3, 50, "ACQUIRE", rank=2),
        event(6, 4, 1, "CANCEL", rank=3, end=99), event(7, 4, 50, "ACQUIRE", rank=2),
    )
    total = {}
    for r in lifecycle.acquired_subscribers(df).collect():
        for name in ("acquired", "first_time", "true_expire", "upgrade", "downgrade"):
            total[name] = total.get(name, 0) + r[name]
    assert total == {
        "acquired": 4, "first_time": 1, "true_expire": 1, "upgrade": 1, "downgrade": 1,
    }


def test_trials(spark):
    df = events(
        spark,
        event(1, 1, 1, "TRIAL"), event(2, 1, 5, "RENEWAL"), event(3, 1, 9, "CANCEL"),
        event(4, 2, 2, "TRIAL"), event(5, 2, 5, "CANCEL"),
        event(6, 3, 3, "TRIAL"),
        event(7, 4, 1, "RENEWAL"), event(8, 4, 4, "TRIAL"),
    )
    (row,) = lifecycle.trial_conversions(df).collect()
    assert (row.signups, row.conversions, row.cancellations, row.open_trials) == (4, 1, 1, 2)


def test_churn_and_cancellation_classes(spark):
    reasons = ["AUTO_RENEW_OFF", "REFUND", "HARD_DECLINE", "SOFT_DECLINE", "CHARGEBACK", "MOVED", None]
    df = events(
        spark, *[event(n, n, 1, "CANCEL", reason=r) for n, r in enumerate(reasons)],
        event(90, 90, 1, "RENEWAL"), event(91, 91, 1, "SWITCH"),
    )
    (row,) = lifecycle.renewals_summary(df).collect()
    assert (row.renewals, row.voluntary_churn, row.involuntary_churn, row.switches) == (1, 2, 5, 1)
    got = {r.cancellation_class: r.cancellations for r in lifecycle.cancellations(df).collect()}
    assert got == {
        "auto-renew-off": 1, "refund": 1, "hard decline": 1, "soft decline": 1, "chargeback": 1,
        "other": 2,
    }


def test_attempts_past_the_tenth_are_kept(spark):
    tries = [
        event(n, 1, n, "PAYMENT", result="FAILURE" if n < 13 else "SUCCESS", invoice="i")
        for n in range(1, 14)
    ]
    (row,) = lifecycle.payment_failures(events(spark, *tries)).collect()
    assert row.attempts == 13
    assert [row[f"failure_{n}"] for n in range(1, 11)] == [1] * 10
    assert (row.failure_later, row.success_later, row.success_1) == (2, 1, 0)


def test_switches(spark):
    df = events(
        spark,
        event(1, 1, 1, "ACQUIRE", "basic", 1), event(2, 1, 30, "SWITCH", "premium", 3),
        event(3, 1, 60, "SWITCH", "premium", 3), event(4, 1, 90, "SWITCH", "family", 2),
    )
    got = {(r.from_plan, r.to_plan): r.direction for r in lifecycle.plan_switches(df).collect()}
    assert got == {("basic", "premium"): "upgrade", ("premium", "family"): "downgrade"}


def test_the_pacific_variant_moves_the_day(spark):
    df = events(spark, event(1, 1, 24 + 3, "CANCEL"))
    utc, local = (
        lifecycle.cancellations(df, zone).collect()[0].event_date for zone in (None, PACIFIC)
    )
    assert (utc, local) == (date(1970, 1, 2), date(1970, 1, 1))


def test_active_snapshot(spark):
    df = events(
        spark, event(1, 1, 1, "ACQUIRE"), event(2, 1, 2, "CANCEL"), event(3, 2, 2, "CANCEL"),
        event(4, 2, 2, "ACQUIRE"),
    )
    (row,) = lifecycle.active_snapshot(df).collect()
    assert row.active_subscribers == 1


def test_erp_extract_is_written_as_text(spark, tmp_path):
    df = events(spark, event(1, 1, 1, "ACQUIRE"), event(2, 2, 2, "RENEWAL"))
    path = str(tmp_path / "erp")
    write_csv_extract(lifecycle.erp_extract(df), path)
    (row,) = spark.read.option("header", True).csv(path).collect()
    assert tuple(row) == ("01-01-1970", "SUBS-BASIC", "USD", "2", "10.00")


def test_every_trial_counts(spark):
    from tillroll.operators.lifecycle import trial_conversions

    day = 86400
    events = [
        (1, 1, "TRIAL", 0), (2, 1, "TRIAL", 100 * day), (3, 1, "RENEWAL", 110 * day),
        (4, 2, "TRIAL", 0), (5, 2, "CANCEL", 5 * day), (6, 2, "TRIAL", 50 * day),
    ]
    df = spark.createDataFrame(events, "event_id long, subscription_id long, kind string, event_epoch long")
    got = {str(r.signup_date): tuple(r)[1:] for r in trial_conversions(df).collect()}
    assert got == {
        "1970-01-01": (2, 0, 1, 1), "1970-02-20": (1, 0, 0, 1), "1970-04-11": (1, 1, 0, 0)
    }
