"""Recomputing the stored results: monitor master, monitor config, accrual, subscriber bitmaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.accrual import WINDOW_MONTHS, AccrualLookups, accrual, with_run_stamp
from tillroll.operators.bitmaps import count_subscribers, subscriber_bitmaps
from tillroll.operators.monitor import (
    collected_files,
    ingestion_monitor,
    master_rows,
    stamp_config,
)
from tillroll.operators.skus import (
    apple_sales_values,
    classify_skus,
    promoted_skus,
    store_sales,
)
from tillroll.sources.schemas import CHANNELS
from tillroll.sources.tables import GOOGLE_SECOND_RAW, RevenueTables


@dataclass(frozen=True)
class Layers:
    """The tables that a source's files pass through; each has file_tx_id."""

    raw: Sequence[DataFrame]
    typed: DataFrame
    fact: DataFrame


def layers_of(tables: RevenueTables, provider: str) -> Layers:
    """The stored layers of one provider."""
    raw = [tables.read(f"raw_{provider}")]
    if provider == "google":
        raw.append(tables.read(GOOGLE_SECOND_RAW))
    if provider == "apple":
        fact = tables.read("apple_sales")
    else:
        fact = tables.read("payments").where(F.col("pmt_channel") == CHANNELS[provider][0])
    return Layers(raw, tables.read(f"typed_{provider}"), fact)


def monitor_of_layers(files: DataFrame, layers: Layers) -> DataFrame:
    """The monitor of any source. Every layer is cut to the covered files; where they are its
    partitions, files outside the monitor's months are not opened."""
    covered = files.select("file_tx_id").distinct()

    def of_covered(rows: DataFrame) -> DataFrame:
        return rows.select("file_tx_id").join(covered, "file_tx_id", "left_semi")

    raw = [of_covered(r) for r in layers.raw]
    return ingestion_monitor(files, raw, of_covered(layers.typed), of_covered(layers.fact))


def monitor_of(
    tables: RevenueTables,
    mv_id: str,
    provider: str,
    as_of: date,
    layers: Layers | None = None,
) -> DataFrame:
    """The monitor of one source, over its stored layers or over the given ones."""
    files = collected_files(
        tables.read("collection_audit"), tables.audit(), tables.monitor_config(), mv_id, as_of
    )
    return monitor_of_layers(files, layers or layers_of(tables, provider))


def refresh_monitor(
    tables: RevenueTables,
    mv_id: str,
    provider: str,
    as_of: date,
    layers: Layers | None = None,
) -> None:
    """Replace the monitor's part of the master and note its extent in the config."""
    rows = monitor_of(tables, mv_id, provider, as_of, layers)
    tables.replace_partition("ingestion_master", master_rows(rows, mv_id), mv_id=mv_id)
    now = F.localtimestamp()
    stamped = stamp_config(tables.monitor_config(), tables.read("ingestion_master"), mv_id, now)
    tables.append("monitor_config_log", stamped)


def refresh_skus(tables: RevenueTables) -> None:
    """Classify and promote over the whole facts, whatever single loads have done."""
    payments, apple = tables.payments(), tables.read("apple_sales")
    tables.append("sku_log", classify_skus(payments, apple, tables.skus()))
    sales = store_sales(payments).unionByName(apple_sales_values(apple))
    tables.append("sku_log", promoted_skus(tables.skus(), sales))


def refresh_accrual(
    tables: RevenueTables,
    lookups: AccrualLookups,
    as_of: date,
    path: str,
    channels: Sequence[str] = ("Amazon",),
) -> None:
    """Store the whole accrual as of a day, one folder per day; repeating a day replaces it. Files whose days
    lie outside the accrual's window are not opened."""
    payments = tables.payments(F.add_months(F.lit(as_of), -WINDOW_MONTHS), as_of)
    rows = accrual(payments, lookups, as_of, channels)
    with_run_stamp(rows).write.mode("overwrite").parquet(f"{path}/as_of={as_of.isoformat()}")


def refresh_subscribers(tables: RevenueTables, history: DataFrame, as_of: date) -> None:
    """Store the subscriber bitmaps as of the end of a day; repeating a day replaces it."""
    known = history.where(F.col("updated_timestamp") < F.date_add(F.lit(as_of), 1))
    tables.replace_partition("subscriber_bitmaps", subscriber_bitmaps(known), as_of=as_of)


def stored_subscribers(tables: RevenueTables, as_of: date, **choice) -> DataFrame:
    """`count_subscribers` of a stored day; only that day's partition is read."""
    day = tables.read("subscriber_bitmaps").where(F.col("as_of") == F.lit(as_of))
    return count_subscribers(day, **choice)
