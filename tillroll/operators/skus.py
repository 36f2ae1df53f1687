"""SKU reference: classify new SKUs by name, promote those that earn, report unknown ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import TOTAL
from tillroll.functions.text import by_value, first_match, like_any
from tillroll.sources.schemas import SKU_KEY, SKUS

STORE_CHANNELS = ("Amazon", "Google", "Roku")

# Realm of a file region, and of a SKU prefix in the region that has several realms.
REGION_REALMS = {
    "AMER": "go",
    "EMEA": "dplay",
    "APAC": "streaming_apac",
    "MAX": "streaming",
    "MAXTR": "streaming",
    "CNN": "streaming",
    "ESP": "eurosport",
    "MT": "motortrend",
    "INDIA": "streaming_india",
}
PREFIX_REALMS = (
    ("br_%", "go"),
    ("ca_%", "go"),
    ("us_%", "go"),
    ("dplus_%", "go"),
    ("de.%", "dplay"),
    ("ie_%", "dplay"),
    ("uk_%", "dplay"),
)
APPLE_PREFIX_REALMS = tuple(r for r in PREFIX_REALMS if r[0] not in ("dplus_%", "ie_%"))
MAX_SOURCE_REGIONS = (
    ("%.us%", "amer"),
    ("stream.%", "amer"),
    ("%latam%", "latam"),
    ("%.lat.%", "latam"),
    ("%emea%", "emea"),
    ("%apac%", "apac"),
)
YEARLY = ("%annual%", "%.year%", "%.1y%", "%12month%", "%12m.%")
APPLE_YEARLY = ("%annual%", "%.year%", "%12month%")
TIERS = (
    ("%premium%", "premium"),
    ("%svod%", "ad_free"),
    ("%avod%", "ad_lite"),
    ("%lite%", "ad_lite"),
    ("%light%", "ad_lite"),
)
APPLE_TIERS = tuple(r for r in TIERS if r[0] != "%light%")
ACCRUAL_REGIONS = ("AMER", "MAX", "DPLUS", "EMEA", "ESP", "CNN", "MAXTR", "INDIA")
NEVER_ACCRUED = ("%.foodnetwork.%", "%golftv%", "%ppv%")


def subscription_rows(channels: Sequence[str] = STORE_CHANNELS) -> Column:
    """Payment rows that count as a subscription sale, each channel by its own words."""
    kind, record = F.col("type"), F.col("record_type")
    tests = {
        "Amazon": (record == "Charge") & (kind == "Subscription"),
        "Google": (record == "Charged") & kind.ilike("subscription"),
        "Roku": record.isin("Purchase", "UpgradeSale"),
    }
    wanted = F.lit(False)
    for channel in channels:
        wanted = wanted | ((F.col("pmt_channel") == channel) & tests[channel])
    return F.col("pmt_channel").isin(*channels) & wanted


def _attributes(
    sku: Column,
    region: Column,
    prefixes: Sequence[tuple[str, str]],
    yearly: Sequence[str],
    tiers: Sequence[tuple[str, str]],
    source_regions: dict[str, str],
) -> dict[str, Column]:
    realm = F.when(region == "DPLUS", first_match(sku, prefixes, "go")).otherwise(
        by_value(region, REGION_REALMS)
    )
    source = F.when(region == "MAX", first_match(sku, MAX_SOURCE_REGIONS, "amer")).otherwise(
        by_value(region, source_regions)
    )
    return {
        "realm": realm,
        "source_region": source,
        "payment_period": F.when(like_any(sku, yearly), "YEAR").otherwise("MONTH"),
        "tier_type": first_match(sku, tiers, "ad_free"),
    }


def _new_skus(
    found: DataFrame, sku_ref: DataFrame, attributes: dict[str, Column], included: Column
) -> DataFrame:
    """Grouped SKUs that the reference lacks, as reference rows."""
    known = sku_ref.select(*SKU_KEY)
    fresh = found.join(known, list(SKU_KEY), "left_anti")
    values = {
        **attributes,
        "included_in_accrual_yn": F.when(included, "Y").otherwise("N"),
        "partner_revenue_share": F.lit(0),
        "auto_generated_yn": F.lit("Y"),
    }
    return fresh.select(*[values.get(n, F.col(n)).cast(k).alias(n) for n, k in SKUS.items()])


def classify_payment_skus(payments: DataFrame, sku_ref: DataFrame) -> DataFrame:
    """New SKUs of Amazon, Google and Roku. The payments shrink to one row per SKU before any
    shuffle or join."""
    found = (
        payments.where(subscription_rows() & F.col("vendor_sku").isNotNull())
        .groupBy(
            F.col("pmt_channel").alias("payment_provider"),
            F.col("vendor_sku").alias("sku_id"),
            "file_tx_region",
        )
        .agg(
            F.sum("main_amount").alias("_amount"),
            F.min("utc_timestamp").alias("sku_create_timestamp"),
        )
    )
    sku, region = F.col("sku_id"), F.col("file_tx_region")
    attributes = _attributes(
        sku, region, PREFIX_REALMS, YEARLY, TIERS, {"MAXTR": "emea", "CNN": "cnn"}
    )
    # A NULL region is on neither list, so it does not keep a SKU out.
    included = (
        F.coalesce(region.isin(*ACCRUAL_REGIONS), F.lit(True))
        & ~like_any(sku, NEVER_ACCRUED)
        & (F.col("_amount") != 0)
    )
    return _new_skus(found, sku_ref, attributes, included)


def _apple_sales(apple: DataFrame) -> DataFrame:
    return (
        apple.where(F.col("subscription").isin("Renewal", "New") & F.col("sku").isNotNull())
        .groupBy(
            F.lit("Apple").alias("payment_provider"),
            F.col("sku").alias("sku_id"),
            "file_tx_region",
        )
        .agg(
            F.sum(F.abs("customer_price") * F.col("units")).alias("_amount"),
            F.min("end_date").alias("_first_day"),
        )
    )


def classify_apple_skus(apple: DataFrame, sku_ref: DataFrame) -> DataFrame:
    """New Apple SKUs; fewer patterns apply than for the other stores, and only APAC is left out."""
    found = _apple_sales(apple).withColumn(
        "sku_create_timestamp", F.col("_first_day").cast("timestamp_ntz")
    )
    sku, region = F.col("sku_id"), F.col("file_tx_region")
    attributes = _attributes(
        sku, region, APPLE_PREFIX_REALMS, APPLE_YEARLY, APPLE_TIERS, {"CNN": "cnn"}
    )
    included = (
        ~region.eqNullSafe(F.lit("APAC"))
        & ~like_any(sku, NEVER_ACCRUED)
        & (F.col("_amount") != 0)
    )
    return _new_skus(found, sku_ref, attributes, included)


def classify_skus(payments: DataFrame, apple: DataFrame, sku_ref: DataFrame) -> DataFrame:
    """All new SKUs, ready to append to the reference."""
    return classify_payment_skus(payments, sku_ref).unionByName(classify_apple_skus(apple, sku_ref))


def _may_be_promoted() -> Column:
    return (
        (F.col("auto_generated_yn") == "Y")
        & (F.col("included_in_accrual_yn") == "N")
        & F.col("file_tx_region").isin(*ACCRUAL_REGIONS)
        & ~like_any(F.col("sku_id"), NEVER_ACCRUED)
    )


def store_sales(payments: DataFrame) -> DataFrame:
    """Payments of the three stores as SKU keys and absolute amounts; no filter on their type."""
    return payments.where(F.col("pmt_channel").isin(*STORE_CHANNELS)).select(
        F.col("pmt_channel").alias("payment_provider"),
        F.col("vendor_sku").alias("sku_id"),
        "file_tx_region",
        F.abs("main_amount").cast(TOTAL).alias("value"),
    )


def apple_sales_values(apple: DataFrame) -> DataFrame:
    """Apple sales as SKU keys and values; returned units count against."""
    return apple.where(F.col("subscription").isin("Renewal", "New")).select(
        F.lit("Apple").alias("payment_provider"),
        F.col("sku").alias("sku_id"),
        "file_tx_region",
        (F.abs("customer_price") * F.col("units")).cast(TOTAL).alias("value"),
    )


def sku_revenue(sales: DataFrame) -> DataFrame:
    """Sales as one sum per SKU, as the ledger of SKU sales keeps them for each file."""
    known = sales.where(F.col("sku_id").isNotNull() & F.col("value").isNotNull())
    return known.groupBy(*SKU_KEY).agg(F.sum("value").cast(TOTAL).alias("value"))


def _earning(sales: DataFrame) -> DataFrame:
    """SKUs with revenue. Sales shrink to one row per SKU before they meet the reference, so their
    rows are never shuffled for the join, however long the reference is."""
    revenue = sales.groupBy(*SKU_KEY).agg(F.sum("value").alias("_revenue"))
    return revenue.where(F.col("_revenue") > 0)


def promoted_skus(sku_ref: DataFrame, sales: DataFrame) -> DataFrame:
    """The reference rows that the sales turn from N to Y."""
    return sku_ref.where(_may_be_promoted()).join(_earning(sales), list(SKU_KEY), "left_semi").select(
        *[F.lit("Y").alias(c) if c == "included_in_accrual_yn" else c for c in sku_ref.columns]
    )


def promote_skus(sku_ref: DataFrame, payments: DataFrame, apple: DataFrame) -> DataFrame:
    """The whole reference after promotion."""
    sales = store_sales(payments).unionByName(apple_sales_values(apple))
    promoted = _may_be_promoted() & F.col("_revenue").isNotNull()
    included = F.when(promoted, "Y").otherwise(F.col("included_in_accrual_yn"))
    return sku_ref.join(_earning(sales), list(SKU_KEY), "left").select(
        *[included.alias(c) if c == "included_in_accrual_yn" else c for c in sku_ref.columns]
    )


def new_sku_alert(rows: DataFrame, sku_ref: DataFrame) -> DataFrame:
    """SKUs seen in payments (or accruals) and missing from the reference, with their volume."""
    seen = (
        rows.where(F.col("sku_id").isNotNull())
        .groupBy(*SKU_KEY)
        .agg(
            F.count("*").alias("rows"),
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
        )
    )
    return seen.join(sku_ref.select(*SKU_KEY), list(SKU_KEY), "left_anti")
