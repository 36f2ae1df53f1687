"""Subscriber counts from stored bitmaps.

Distinct counts of parts do not add up: a subscriber of two realms is one subscriber of both. So each part
(provider, realm, region, status) keeps the set of its subscribers as a bitmap over dense numbers, 32,768
numbers a row; any choice of parts is then an OR of rows, and neither history nor ids are read again.

The numbers hold for one set of bitmaps; bitmaps of two days are not to be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.realms import MAX_REALMS, realm_filter, subscriber_id, wildcard
from tillroll.operators.subscriptions import latest_subscriptions

PARTS = ("payment_provider", "realm", "source_region", "status")
CELLS = 4096


def subscriber_bitmaps(history: DataFrame, cells: int = CELLS) -> DataFrame:
    """The parts of the latest subscriptions: PARTS, bucket, bits, and the subscriptions of these bits.

    A Discovery subscription id and a MAX global id are different subscribers, also where they are spelled
    alike. Subscriptions without a subscriber id have no bit. Subscribers are numbered in `cells` parts by
    a hash of the id, after equal rows are counted, so no task holds all subscribers or one id's history.
    """
    kind = F.col("realm").isin(*MAX_REALMS)
    who = subscriber_id(F.col("realm"), F.col("subscription_id"), F.col("global_subscription_id"))
    counted = (
        latest_subscriptions(history)
        .groupBy(*PARTS, F.when(who.isNotNull(), kind).alias("_kind"), who.alias("_who"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_cell", F.pmod(F.xxhash64("_kind", "_who"), F.lit(cells)))
    )
    place = F.dense_rank().over(Window.partitionBy("_cell").orderBy("_kind", "_who"))
    placed = counted.withColumn("_place", place.cast("bigint"))
    sizes = placed.groupBy("_cell").agg(F.max("_place").alias("_size"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    starts = sizes.select("_cell", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    number = F.when(F.col("_who").isNotNull(), F.col("_start") + F.col("_place"))
    numbered = placed.join(starts, "_cell").withColumn("_number", number)
    bucket = F.coalesce(F.bitmap_bucket_number("_number"), F.lit(0)).cast("bigint")
    return numbered.groupBy(*PARTS, bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("bits"),
        F.sum("_n").alias("subscriptions"),
    )


def count_subscribers(
    bitmaps: DataFrame,
    by: Sequence[str] = PARTS,
    provider: str = "%",
    realm: str = "%",
    source_region: str = "%",
    status: str = "ACTIVE",
) -> DataFrame:
    """Distinct subscribers and subscriptions of the chosen parts, per `by` (some of PARTS, or none).

    With all of PARTS the rows are those of `active_subscribers`. A subscriber of several parts of one
    group counts once. Without `by` there is one row, of zeros if nothing is chosen.
    """
    if not set(by) <= set(PARTS):
        raise ValueError(f"subscribers are counted by some of {PARTS}")
    chosen = bitmaps.where(
        wildcard(F.col("payment_provider"), provider)
        & realm_filter(F.col("realm"), realm)
        & wildcard(F.col("source_region"), source_region)
        & wildcard(F.col("status"), status)
    )
    merged = chosen.groupBy(*by, "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("_set"), F.sum("subscriptions").alias("_n")
    )
    return merged.groupBy(*by).agg(
        F.coalesce(F.sum("_set"), F.lit(0)).alias("subscribers"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("subscriptions"),
    )
