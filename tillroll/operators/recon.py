"""Payment reconciliation: provider payments against internal charges.

A match is one to one: the n-th payment of a match key pairs with its n-th charge, so two equal
charges need two payments. Both sides are numbered within the key (cell by cell, see `ordered`) and
joined on key and number, which no hot key can skew. A NULL or blank reference identifies nothing:
its rows are unmatched and never shuffled into one group. A matcher lists every charge it is given, so
charges of other providers come out as CHARGE_ONLY: `reconcile` cuts them to the provider's own.

Payments: payment_id, merchant_account, record_type, psp_reference, merchant_reference,
invoice_number, event_code, product_id, subscription_id, amount, currency, utc_timestamp.
payment_id and charge_id are unique. Charges: charge_id, merchant_account, transaction_type, psp_reference, vendor_reference_id,
merchant_reference, invoice_id, product_id, subscription_id, amount, currency, charged_timestamp.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import RATE, TOTAL
from tillroll.functions.text import blank_to_null, by_value
from tillroll.operators.intervals import pair_within_days
from tillroll.operators.lookups import unique_lookup
from tillroll.operators.ordered import exact_quantiles, hour_bucket, position

MATCHED = "MATCHED"
PAYMENT_ONLY = "PAYMENT_ONLY"
CHARGE_ONLY = "CHARGE_ONLY"

# Record type of each internal transaction type, accounts with the short refund
# match, the event codes and the separate account class of the second provider.
ADYEN_RECORD_TYPES = {
    "CHARGE": "Authorised",
    "FIRST": "Authorised",
    "RECURRING": "Authorised",
    "REFUND": "SentForRefund",
    "CHARGEBACK": "Chargeback",
}
SHORT_REFUND_ACCOUNTS = ("Motortrend", "Foodnetwork")
PAYPAL_EVENT_CODES = ("T0003", "T0006", "T1107")
HBOUS_ACCOUNT = "HBOUS"
PGA_TOUR_PRODUCT = "%pgatour%"


def _reference(name: str) -> Column:
    return blank_to_null(F.col(name))


def _one_to_one(payments: DataFrame, charges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair rows by key and number. Both sides come with the key columns, `_id` and `_at`.

    A row with a NULL key gets a key of its own, so that it is numbered alone and pairs with nothing.
    """
    by = [*keys, "_own"]
    sides = []
    for name, df in (("payment", payments), ("charge", charges)):
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        own = F.when(~whole, F.concat(F.lit(f"{name} "), F.col("_id").cast("string")))
        keyed = df.withColumn("_own", F.coalesce(own, F.lit(""))).withColumns(
            {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}
        )
        sides.append(position(keyed, by, ["_at", "_id"], hour_bucket(F.col("_at")), "_nr"))
    left, right = sides
    left = left.withColumnsRenamed({"_id": "payment_id", "_at": "paid_at"})
    right = right.withColumnsRenamed({"_id": "charge_id", "_at": "charged_at"})
    return left.join(right, [*by, "_nr"], "full").drop("_nr", "_own")


def _state() -> Column:
    return (
        F.when(F.col("charge_id").isNull(), PAYMENT_ONLY)
        .when(F.col("payment_id").isNull(), CHARGE_ONLY)
        .otherwise(MATCHED)
    )


def _detail(pairs: DataFrame) -> DataFrame:
    """Level 3: one row per pair or unmatched row."""
    return pairs.select(
        F.coalesce(F.col("paid_at"), F.col("charged_at")).cast("date").alias("recon_date"),
        _state().alias("state"),
        "payment_id",
        "charge_id",
        "psp_reference",
        "merchant_account",
        "record_type",
        "product_id",
        "payment_amount",
        "charge_amount",
    )


def _payment_side(payments: DataFrame, *keys: Column) -> DataFrame:
    return payments.select(
        *keys,
        F.col("payment_id").alias("_id"),
        F.col("utc_timestamp").alias("_at"),
        F.col("psp_reference").alias("_p_reference"),
        F.col("merchant_account").alias("_p_account"),
        F.col("record_type").alias("_p_type"),
        F.col("product_id").alias("_p_product"),
        F.col("amount").alias("payment_amount"),
    )


def _charge_side(
    charges: DataFrame, record_type: Column, reference: str, *keys: Column
) -> DataFrame:
    return charges.select(
        *keys,
        F.col("charge_id").alias("_id"),
        F.col("charged_timestamp").alias("_at"),
        F.col(reference).alias("_c_reference"),
        F.col("merchant_account").alias("_c_account"),
        record_type.alias("_c_type"),
        F.col("product_id").alias("_c_product"),
        F.col("amount").alias("charge_amount"),
    )


def _merged(pairs: DataFrame) -> DataFrame:
    """Shared attributes from the payment, or from the charge where there is no payment."""

    def either(payment: str, charge: str) -> Column:
        return F.when(F.col("payment_id").isNotNull(), F.col(payment)).otherwise(F.col(charge))

    return pairs.select(
        "*",
        either("_p_reference", "_c_reference").alias("psp_reference"),
        either("_p_account", "_c_account").alias("merchant_account"),
        either("_p_type", "_c_type").alias("record_type"),
        either("_p_product", "_c_product").alias("product_id"),
    )


def match_adyen(payments: DataFrame, charges: DataFrame) -> DataFrame:
    """Charges are translated to record types, each with its own key: Authorised by PSP and merchant
    reference, SentForRefund the same but by PSP reference alone for two accounts, Chargeback by PSP
    reference alone. The key's unused part is blank, so the three strategies are one join."""
    kinds = sorted(set(ADYEN_RECORD_TYPES.values()))

    def keys(record_type: Column) -> list[Column]:
        short = F.col("merchant_account").isin(*SHORT_REFUND_ACCOUNTS)
        without_merchant = (record_type == "Chargeback") | (
            (record_type == "SentForRefund") & F.coalesce(short, F.lit(False))
        )
        merchant = F.when(without_merchant, F.lit("")).otherwise(_reference("merchant_reference"))
        return [
            record_type.alias("_k0"),
            _reference("psp_reference").alias("_k1"),
            merchant.alias("_k2"),
        ]

    kind = by_value(F.col("transaction_type"), ADYEN_RECORD_TYPES)
    paid = payments.where(F.col("record_type").isin(*kinds))
    charged = charges.where(F.col("transaction_type").isin(*ADYEN_RECORD_TYPES))
    pairs = _one_to_one(
        _payment_side(paid, *keys(F.col("record_type"))),
        _charge_side(charged, kind, "psp_reference", *keys(kind)),
        ["_k0", "_k1", "_k2"],
    )
    return _detail(_merged(pairs))


def match_paypal(payments: DataFrame, charges: DataFrame) -> DataFrame:
    """PSP reference and invoice number among three event codes; the HBOUS account is kept apart
    and matches by PSP reference alone."""

    def keys(invoice: str) -> list[Column]:
        apart = F.coalesce(F.col("merchant_account") == HBOUS_ACCOUNT, F.lit(False))
        return [
            apart.alias("_k0"),
            _reference("psp_reference").alias("_k1"),
            F.when(apart, F.lit("")).otherwise(_reference(invoice)).alias("_k2"),
        ]

    paid = payments.where(F.col("event_code").isin(*PAYPAL_EVENT_CODES))
    pairs = _one_to_one(
        _payment_side(paid, *keys("invoice_number")),
        _charge_side(charges, F.col("transaction_type"), "psp_reference", *keys("invoice_id")),
        ["_k0", "_k1", "_k2"],
    )
    return _detail(_merged(pairs))


def match_google(payments: DataFrame, charges: DataFrame) -> DataFrame:
    """PSP reference against the charge's vendor reference, PGA Tour products left out."""
    golf = F.coalesce(F.col("product_id").ilike(PGA_TOUR_PRODUCT), F.lit(False))
    pairs = _one_to_one(
        _payment_side(payments.where(~golf), _reference("psp_reference").alias("_k0")),
        _charge_side(
            charges.where(~golf),
            F.col("transaction_type"),
            "vendor_reference_id",
            _reference("vendor_reference_id").alias("_k0"),
        ),
        ["_k0"],
    )
    return _detail(_merged(pairs))


def match_amazon(payments: DataFrame, charges: DataFrame, days: int = 1) -> DataFrame:
    """A payment matches a charge of its subscription whose vendor reference is the payment's and whose day
    is at most `days` from the payment's day, one to one: as many pairs as can be (see `intervals`). A pair
    is one row, dated by the payment. Payments without subscription or reference match nothing, charges
    neither."""

    def side(rows: DataFrame, mark: str, ident: str, reference: str, kind: str, at: str) -> DataFrame:
        return rows.select(
            F.col("subscription_id").alias("_subscription"),
            _reference(reference).alias("_reference"),
            F.col(ident).alias("_id"),
            F.col(at).alias("_at"),
            F.col(at).cast("date").alias(f"_{mark}_day"),
            F.col("subscription_id").alias(f"_{mark}_subscription"),
            F.col(reference).alias(f"_{mark}_reference"),
            F.col("merchant_account").alias(f"_{mark}_account"),
            F.col(kind).alias(f"_{mark}_type"),
            F.col("product_id").alias(f"_{mark}_product"),
            F.col("amount").alias(f"_{mark}_amount"),
        )

    paid = side(payments, "p", "payment_id", "psp_reference", "record_type", "utc_timestamp")
    charged = side(charges, "c", "charge_id", "vendor_reference_id", "transaction_type", "charged_timestamp")
    pairs = pair_within_days(paid, charged, ["_subscription", "_reference"], "_at", "_id", days)
    pairs = pairs.withColumnsRenamed({"_id_left": "payment_id", "_id_right": "charge_id"})

    def either(name: str) -> Column:
        return F.when(F.col("payment_id").isNotNull(), F.col(f"_p_{name}")).otherwise(F.col(f"_c_{name}"))

    return pairs.select(
        either("day").alias("recon_date"),
        _state().alias("state"),
        "payment_id",
        "charge_id",
        either("subscription").alias("subscription_id"),
        either("reference").alias("psp_reference"),
        either("account").alias("merchant_account"),
        either("type").alias("record_type"),
        either("product").alias("product_id"),
        F.col("_p_amount").alias("payment_amount"),
        F.col("_c_amount").alias("charge_amount"),
    )


MATCHERS = {
    "Adyen": match_adyen,
    "PayPal": match_paypal,
    "Google": match_google,
    "Amazon": match_amazon,
}


def reconcile(provider: str, payments: DataFrame, charges: DataFrame) -> DataFrame:
    """The provider's payments against its own charges: those whose payment_provider it is, in any case.
    Charges without a provider belong to none. Payments are the provider's own; where they have a
    payment_provider too, they are cut in the same way."""

    def own(rows: DataFrame) -> DataFrame:
        if "payment_provider" not in rows.columns:
            return rows
        return rows.where(F.lower("payment_provider") == provider.lower())

    if "payment_provider" not in charges.columns:
        raise ValueError("charges have no payment_provider")
    return MATCHERS[provider](own(payments), own(charges))


def within_dates(detail: DataFrame, first: date, last: date) -> DataFrame:
    """The part of a match that lies between two days, both included. Cutting after the match keeps
    pairs whole whose sides lie on either side of an edge."""
    return detail.where(F.col("recon_date").between(F.lit(first), F.lit(last)))


def vendor_reference_lists(charges: DataFrame, size: int = 1000) -> DataFrame:
    """Each subscription's vendor references as text lists, in the order they were charged.

    A list holds up to `size` references and a longer history goes on in the next one, so nothing
    is lost and no row grows without bound.
    """
    references = (
        charges.where(
            _reference("vendor_reference_id").isNotNull() & F.col("subscription_id").isNotNull()
        )
        .groupBy("subscription_id", "vendor_reference_id")
        .agg(F.min(F.col("charged_timestamp").cast("date")).alias("_day"))
    )
    placed = position(
        references,
        ["subscription_id"],
        ["_day", "vendor_reference_id"],
        F.unix_date("_day"),
        "_nr",
    )
    part = F.floor((F.col("_nr") - 1) / F.lit(size)).cast("int")
    return (
        placed.withColumn("list_nr", part)
        .groupBy("subscription_id", "list_nr")
        .agg(
            F.count("*").alias("references"),
            F.expr("listagg(vendor_reference_id, ',') within group (order by _nr)").alias(
                "vendor_references"
            ),
        )
    )


def recon_levels(detail: DataFrame) -> DataFrame:
    """Levels 0 to 2 over a match: the total, each day, and each day's account, type and product.

    The finest level is counted from the rows; the other two are sums over it.
    """
    finest_keys = ["recon_date", "merchant_account", "record_type", "product_id"]
    finest = detail.groupBy(*finest_keys).agg(
        F.count("*").alias("_rows"),
        F.count(F.when(F.col("state") == MATCHED, 1)).alias("_matched"),
    )
    columns = [F.col(k) for k in finest_keys]
    grouped = finest.groupingSets([[], columns[:1], columns], *columns).agg(
        F.grouping("recon_date").alias("_no_day"),
        F.grouping("product_id").alias("_no_product"),
        F.sum("_matched").alias("matched"),
        F.sum("_rows").alias("total"),
    )
    level = (
        F.when(F.col("_no_day") == 1, 0).when(F.col("_no_product") == 1, 1).otherwise(2)
    ).cast("int")
    unmatched = F.col("total") - F.col("matched")
    hundred = F.lit(100).cast("decimal(3,0)")
    return grouped.select(
        level.alias("level"),
        *finest_keys,
        F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"),
        F.coalesce(unmatched, F.lit(0)).cast("bigint").alias("unmatched"),
        F.round(unmatched * hundred / F.nullif("total", F.lit(0)), 4)
        .cast("double")
        .alias("pct_unmatched"),
    )


def settlement(payments: DataFrame, charges: DataFrame, rates: DataFrame) -> DataFrame:
    """Charged against paid amounts by date and currency, with the difference in USD.

    Both sides are summed before the outer join, so it works on one row per day and currency.
    """
    charged = charges.groupBy(
        F.col("charged_timestamp").cast("date").alias("settle_date"), "currency"
    ).agg(
        F.sum("amount").cast(TOTAL).alias("charge_amount"), F.count("*").alias("charges")
    )
    paid = payments.groupBy(
        F.col("utc_timestamp").cast("date").alias("settle_date"), "currency"
    ).agg(F.sum("amount").cast(TOTAL).alias("payment_amount"), F.count("*").alias("payments"))
    daily = unique_lookup(
        rates.select("currency_code", "exchange_rate_date", "exchange_rate"),
        ["currency_code", "exchange_rate_date"],
        "exchange rates",
    ).select(
        F.col("currency_code").alias("currency"),
        F.col("exchange_rate_date").alias("settle_date"),
        F.col("exchange_rate").alias("_rate"),
    )
    both = charged.join(paid, ["settle_date", "currency"], "full").join(
        daily, ["settle_date", "currency"], "left"
    )
    difference = F.coalesce("charge_amount", F.lit(0)) - F.coalesce("payment_amount", F.lit(0))
    one = F.lit(1).cast(RATE)
    to_usd = (
        F.when(F.col("_rate") == 0, F.lit(0).cast(RATE))
        .when(F.col("currency") == "USD", one)
        .otherwise((F.lit(1) / F.nullif("_rate", F.lit(0))).cast(RATE))
    )
    return both.select(
        "settle_date",
        "currency",
        F.coalesce("charges", F.lit(0)).cast("bigint").alias("charges"),
        F.coalesce("payments", F.lit(0)).cast("bigint").alias("payments"),
        F.coalesce("charge_amount", F.lit(0)).cast(TOTAL).alias("charge_amount"),
        F.coalesce("payment_amount", F.lit(0)).cast(TOTAL).alias("payment_amount"),
        difference.cast(TOTAL).alias("difference"),
        (difference.cast("decimal(24,6)") * to_usd.cast("decimal(14,10)"))
        .cast(TOTAL)
        .alias("difference_usd"),
    )


def settlement_delay(payments: DataFrame) -> DataFrame:
    """Distribution of the seconds from authorisation to settlement or refund, per account and
    later record type. A reference's first Authorised row starts the clock; rows whose reference is
    missing or blank have no clock and are left out.

    Equal delays are counted before they are ranked, so a day's cell holds 86,400 rows at most."""
    started = (
        payments.where(
            (F.col("record_type") == "Authorised") & _reference("psp_reference").isNotNull()
        )
        .groupBy("psp_reference")
        .agg(F.min("utc_timestamp").alias("_start"))
    )
    ended = payments.where(
        F.col("record_type").isin("Settled", "Refunded")
        & _reference("psp_reference").isNotNull()
        & F.col("merchant_account").isNotNull()
    ).select("psp_reference", "merchant_account", "record_type", "utc_timestamp")
    delay = F.timestamp_diff("SECOND", F.col("_start"), F.col("utc_timestamp"))
    delays = ended.join(started, "psp_reference").withColumn("delay_seconds", delay)
    quantiles = exact_quantiles(
        delays,
        ["merchant_account", "record_type"],
        "delay_seconds",
        {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99},
        F.floor(F.col("delay_seconds") / 86400),
    )
    return quantiles.withColumnRenamed("rows", "records")
