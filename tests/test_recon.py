"""Matching against a plain greedy pairing, with repeated and missing references."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tillroll.operators.recon import (
    MATCHERS,
    match_adyen,
    match_amazon,
    match_google,
    match_paypal,
    recon_levels,
    reconcile,
    settlement,
    vendor_reference_lists,
    within_dates,
)
from tillroll.plans.reconcile import reconcile_day, reconciled

PAYMENT = (
    "payment_id bigint, merchant_account string, record_type string, psp_reference string, "
    "merchant_reference string, invoice_number string, event_code string, product_id string, "
    "subscription_id bigint, amount decimal(20,6), currency string, utc_timestamp timestamp_ntz"
)
CHARGE = (
    "charge_id bigint, merchant_account string, transaction_type string, psp_reference string, "
    "vendor_reference_id string, merchant_reference string, invoice_id string, "
    "product_id string, subscription_id bigint, amount decimal(20,6), currency string, "
    "charged_timestamp timestamp_ntz"
)
START = datetime(2024, 1, 1)


def pay(n, ref="r", kind="Authorised", account="A", merchant="m", invoice="i", code="T0003",
        product="go", sub=1, at=START, amount="1", currency="USD"):
    return (n, account, kind, ref, merchant, invoice, code, product, sub, Decimal(amount), currency,
            at)


def charge(n, ref="r", kind="RECURRING", account="A", vendor=None, merchant="m", invoice="i",
           product="go", sub=1, at=START, amount="1", currency="USD"):
    return (n, account, kind, ref, ref if vendor is None else vendor, merchant, invoice, product,
            sub, Decimal(amount), currency, at)


def run(spark, matcher, payments, charges):
    detail = matcher(
        spark.createDataFrame(payments, PAYMENT), spark.createDataFrame(charges, CHARGE)
    )
    return detail.collect()


def states(rows):
    return Counter(r.state for r in rows)


def test_equal_charges_need_as_many_payments(spark):
    rows = run(
        spark, match_adyen, [pay(1), pay(2)], [charge(n) for n in (1, 2, 3, 4)]
    )
    assert states(rows) == {"MATCHED": 2, "CHARGE_ONLY": 2}


def test_adyen_keys_by_record_type(spark):
    payments = [
        pay(1, "a", "Authorised", merchant="x"),
        pay(2, "b", "SentForRefund", merchant="x"),
        pay(3, "c", "SentForRefund", "Motortrend", merchant="x"),
        pay(4, "d", "Chargeback", merchant="x"),
        pay(5, "e", "Settled"),
    ]
    charges = [
        charge(1, "a", "RECURRING"), charge(2, "b", "REFUND"),
        charge(3, "c", "REFUND", "Motortrend"), charge(4, "d", "CHARGEBACK"),
        charge(5, "e", "OTHER"),
    ]
    rows = run(spark, match_adyen, payments, charges)
    assert {r.payment_id for r in rows if r.state == "MATCHED"} == {3, 4}
    assert states(rows) == {"MATCHED": 2, "PAYMENT_ONLY": 2, "CHARGE_ONLY": 2}


@pytest.mark.parametrize("reference", [None, "", "  "])
def test_a_missing_reference_matches_nothing(spark, reference):
    rows = run(spark, match_adyen, [pay(1, reference)], [charge(1, reference)])
    assert states(rows) == {"PAYMENT_ONLY": 1, "CHARGE_ONLY": 1}
    rows = run(spark, match_google, [pay(1, reference)], [charge(1, reference)])
    assert states(rows)["MATCHED"] == 0
    rows = run(spark, match_amazon, [pay(1, reference)], [charge(1, reference)])
    assert states(rows) == {"PAYMENT_ONLY": 1, "CHARGE_ONLY": 1}


def test_paypal_codes_and_the_account_kept_apart(spark):
    payments = [
        pay(1, "a"), pay(2, "b", invoice="other"), pay(3, "c", account="HBOUS", invoice="other"),
        pay(4, "d", code="T9999"), pay(5, "e", account="HBOUS"),
    ]
    charges = [
        charge(1, "a"), charge(2, "b"), charge(3, "c", account="HBOUS"), charge(4, "d"),
        charge(5, "e"),
    ]
    rows = run(spark, match_paypal, payments, charges)
    assert {r.payment_id for r in rows if r.state == "MATCHED"} == {1, 3}
    assert states(rows)["PAYMENT_ONLY"] == 2


def test_google_leaves_out_golf(spark):
    payments = [pay(1, "a"), pay(2, "b", product="PGATour.month"), pay(3, "c", product=None)]
    charges = [charge(n, "x", vendor=v) for n, v in ((1, "a"), (2, "b"), (3, "c"))]
    rows = run(spark, match_google, payments, charges)
    assert {r.payment_id for r in rows if r.state == "MATCHED"} == {1, 3}
    assert {r.payment_id for r in rows} == {1, 3, None}


@pytest.mark.parametrize(
    ("hours", "state"),
    [(0, "MATCHED"), (24, "MATCHED"), (-24, "MATCHED"), (47, "MATCHED"), (48, "PAYMENT_ONLY"),
     (-25, "PAYMENT_ONLY")],
)
def test_amazon_day_window(spark, hours, state):
    rows = run(spark, match_amazon, [pay(1, at=START + timedelta(hours=hours))], [charge(1)])
    unanswered = [] if state == "MATCHED" else ["CHARGE_ONLY"]
    assert sorted(r.state for r in rows) == sorted([state, *unanswered])


def test_amazon_needs_the_subscription(spark):
    rows = run(spark, match_amazon, [pay(1, sub=2), pay(2, sub=None)], [charge(1), charge(2)])
    assert states(rows) == {"PAYMENT_ONLY": 2, "CHARGE_ONLY": 2}


def test_amazon_lists_charges_that_no_payment_answers(spark):
    charges = [charge(1), charge(2, "other"), charge(3, sub=None), charge(4, " ")]
    rows = run(spark, match_amazon, [pay(1), pay(2)], charges)
    assert states(rows) == {"MATCHED": 1, "PAYMENT_ONLY": 1, "CHARGE_ONLY": 3}
    assert {r.charge_id for r in rows if r.state == "CHARGE_ONLY"} == {2, 3, 4}
    pair = next(r for r in rows if r.state == "MATCHED")
    assert (pair.payment_id, pair.charge_id, pair.charge_amount) == (1, 1, Decimal("1"))


def test_amazon_serves_the_payment_whose_window_closes_first(spark):
    def day(n):
        return START + timedelta(days=n)

    payments = [pay(1, at=day(0)), pay(2, at=day(1)), pay(3, at=day(2))]
    charges = [charge(1, at=day(1)), charge(2, at=day(2)), charge(3, at=day(3))]
    rows = run(spark, match_amazon, payments, charges)
    assert {(r.payment_id, r.charge_id) for r in rows} == {(1, 1), (2, 2), (3, 3)}


def most_pairs(payments, charges, days):
    """A maximum matching by augmenting paths."""
    answer = {}

    def place(i, seen):
        for j, other in enumerate(charges):
            if abs(payments[i] - other) <= days and j not in seen:
                seen.add(j)
                if j not in answer or place(answer[j], seen):
                    answer[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(payments)))


@pytest.mark.parametrize("days", [0, 1, 3])
def test_amazon_pairs_are_as_many_as_can_be(spark, days):
    rng = random.Random(days)
    sides = {"p": [], "c": []}
    for sub in range(1, 41):  # subscription 1 holds a third of all rows
        span, many = rng.choice([2, 6, 30]), 240 if sub == 1 else rng.randint(0, 12)
        for side in sides:
            sides[side] += [(sub, rng.randrange(span)) for _ in range(many)]

    def at(n):
        return START + timedelta(days=n, seconds=rng.randrange(86400))

    payments = [pay(i, sub=sub, at=at(n)) for i, (sub, n) in enumerate(sides["p"])]
    charges = [charge(i, sub=sub, at=at(n)) for i, (sub, n) in enumerate(sides["c"])]
    rows = match_amazon(
        spark.createDataFrame(payments, PAYMENT).repartition(3),
        spark.createDataFrame(charges, CHARGE).repartition(3),
        days,
    ).collect()
    pairs = [(r.payment_id, r.charge_id) for r in rows if r.state == "MATCHED"]
    assert len({p for p, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    for p, c in pairs:
        (one, day), (other, answered) = sides["p"][p], sides["c"][c]
        assert one == other and abs(day - answered) <= days
    most = 0
    for sub in range(1, 41):
        most += most_pairs(*[[n for s, n in sides[k] if s == sub] for k in "pc"], days)
    assert len(pairs) == most
    assert states(rows)["PAYMENT_ONLY"] == len(payments) - most
    assert states(rows)["CHARGE_ONLY"] == len(charges) - most


@pytest.mark.parametrize("provider", ["Amazon", "Google"])
def test_daily_runs_find_what_one_run_finds(spark, tables, provider):
    rng = random.Random(11)

    def at(n):
        return START + timedelta(days=n, seconds=rng.randrange(86400))

    def reference():
        return rng.choice(["hot", "hot", f"r{rng.randrange(12)}", "", None])

    payments, charges = [], []
    for n in range(160):
        day = rng.randrange(6)
        sub = rng.randrange(3)
        charges.append(charge(n, vendor=reference(), sub=sub, at=at(day)))
        payments.append(pay(n, reference(), sub=sub, at=at(day)))
    paid, charged = spark.createDataFrame(payments, PAYMENT), spark.createDataFrame(charges, CHARGE)
    whole = MATCHERS[provider](paid, charged).collect()
    for day in (0, 1, 1, 3, 5):  # the second day twice, two days at once
        first, last = {0: (0, 0), 1: (1, 1), 3: (2, 3), 5: (4, 5)}[day]
        span = [START + timedelta(days=first), START + timedelta(days=last + 1)]
        of_day = [
            df.where((F.col(c) >= F.lit(span[0]).cast("timestamp_ntz")) & (F.col(c) < F.lit(span[1]).cast("timestamp_ntz")))
            for df, c in ((paid, "utc_timestamp"), (charged, "charged_timestamp"))
        ]
        reconcile_day(tables, provider, (START + timedelta(days=day)).date(), *of_day)
    daily = reconciled(tables, provider).collect()
    keys = ("state", "payment_id", "charge_id", "recon_date", "payment_amount", "charge_amount")
    assert Counter(tuple(r[k] for k in keys) for r in daily) == Counter(tuple(r[k] for k in keys) for r in whole)
    assert states(whole)["MATCHED"] > 40
    late = [pay(1000, "late", sub=9, at=at(0))], [charge(1000, vendor="late", sub=9, at=at(0))]
    nothing = paid.where("false"), charged.where("false")
    reconcile_day(tables, provider, date(2024, 2, 1), spark.createDataFrame(late[0], PAYMENT), nothing[1])
    reconcile_day(tables, provider, date(2024, 2, 2), nothing[0], spark.createDataFrame(late[1], CHARGE))
    assert (1000, 1000) in {(r.payment_id, r.charge_id) for r in reconciled(tables, provider).collect()}
    with pytest.raises(ValueError, match="before that"):
        reconcile_day(tables, provider, date(2024, 1, 1), *nothing)


def test_reconcile_leaves_charges_of_other_providers_out(spark):
    payments = spark.createDataFrame([pay(1, "a"), pay(2, "b")], PAYMENT)
    charges = [(*charge(1, "a"), "amazon"), (*charge(2, "b"), "Google"), (*charge(3, "c"), None)]
    scoped = spark.createDataFrame(charges, f"{CHARGE}, payment_provider string")
    rows = reconcile("Amazon", payments, scoped).collect()
    assert {(r.payment_id, r.charge_id) for r in rows} == {(1, 1), (2, None)}
    with pytest.raises(ValueError):
        reconcile("Amazon", payments, scoped.drop("payment_provider"))


def test_a_date_range_keeps_pairs_over_its_edge(spark):
    payments = [pay(1, at=START), pay(2, "b", at=START + timedelta(days=5))]
    detail = match_adyen(
        spark.createDataFrame(payments, PAYMENT),
        spark.createDataFrame([charge(1, at=START + timedelta(days=1))], CHARGE),
    )
    rows = within_dates(detail, START.date(), START.date()).collect()
    assert [(r.payment_id, r.charge_id) for r in rows] == [(1, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_against_brute_force_with_a_hot_reference(spark, seed):
    rng = random.Random(seed)

    def reference():
        if rng.random() < 0.34:
            return "hot"
        return rng.choice([None, "", *[f"r{n}" for n in range(40)]])

    def moment():
        return START + timedelta(hours=rng.randrange(500))

    payments = [pay(n, reference(), at=moment()) for n in range(400)]
    charges = [charge(n, reference(), at=moment()) for n in range(400)]
    rows = run(spark, match_adyen, payments, charges)

    waiting = defaultdict(list)
    for c in sorted(charges, key=lambda c: (c[11], c[0])):
        if c[3]:
            waiting[c[3]].append(c[0])
    want = set()
    for p in sorted(payments, key=lambda p: (p[11], p[0])):
        if p[3] and waiting[p[3]]:
            want.add((p[0], waiting[p[3]].pop(0)))
    got = {(r.payment_id, r.charge_id) for r in rows if r.state == "MATCHED"}
    assert got == want
    assert sorted(r.payment_id for r in rows if r.payment_id is not None) == list(range(400))
    assert sorted(r.charge_id for r in rows if r.charge_id is not None) == list(range(400))


def test_levels_add_up(spark):
    detail = match_adyen(
        spark.createDataFrame(
            [pay(n, f"r{n}", at=START + timedelta(days=n % 3)) for n in range(9)], PAYMENT
        ),
        spark.createDataFrame([charge(n, f"r{n}") for n in range(4)], CHARGE),
    )
    rows = recon_levels(detail).collect()
    for level in (0, 1, 2):
        of = [r for r in rows if r.level == level]
        assert sum(r.matched for r in of) == 4
        assert sum(r.unmatched for r in of) == 5
    (total,) = [r for r in rows if r.level == 0]
    assert total.pct_unmatched == 55.5556


def test_lists_are_whole_and_bounded(spark):
    charges = [
        charge(n, f"r{n % 23:02d}", sub=n % 2, at=START + timedelta(hours=n)) for n in range(200)
    ]
    rows = vendor_reference_lists(spark.createDataFrame(charges, CHARGE), size=10).collect()
    assert max(r.references for r in rows) == 10
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.subscription_id, r.list_nr)):
        found[r.subscription_id] += r.vendor_references.split(",")
    assert {k: sorted(v) for k, v in found.items()} == {
        k: sorted({c[4] for c in charges if c[8] == k}) for k in (0, 1)
    }


def test_settlement_keeps_days_of_one_side(spark):
    day = START.date()
    rates = spark.createDataFrame(
        [("EUR", day, Decimal("0.5"))],
        "currency_code string, exchange_rate_date date, exchange_rate decimal(20,6)",
    )
    rows = settlement(
        spark.createDataFrame([pay(1, amount="3", currency="EUR"), pay(2, amount="2")], PAYMENT),
        spark.createDataFrame(
            [charge(1, amount="10", currency="EUR"), charge(2, at=START + timedelta(days=1))], CHARGE
        ),
        rates,
    ).collect()
    got = {(r.settle_date.day, r.currency): (r.difference, r.difference_usd) for r in rows}
    assert got == {
        (1, "EUR"): (Decimal(7), Decimal(14)),
        (1, "USD"): (Decimal(-2), Decimal(-2)),
        (2, "USD"): (Decimal(1), Decimal(1)),
    }
