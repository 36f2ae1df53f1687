"""Loading one provider file: guard, land, type, fact, supersede, SKUs, monitor, audit.

Each step overwrites what the file owns, writes a generation that nobody reads yet, or appends to a log, so
a load that died is repaired by running it again. The new file and the files it replaces change places in
one step: readers of `payments` see the one or the others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.facts import to_apple_fact, to_fact
from tillroll.operators.files import (
    IN_PROGRESS,
    LOAD_ERROR,
    LOADED_FACT,
    SUPERSEDED,
    superseded_files,
    superseding_files,
)
from tillroll.operators.skus import (
    apple_sales_values,
    classify_apple_skus,
    classify_payment_skus,
    promoted_skus,
    sku_revenue,
    store_sales,
)
from tillroll.operators.staging import TYPERS
from tillroll.plans.refresh import refresh_monitor
from tillroll.sources.landing import land_checked
from tillroll.sources.schemas import CHANNELS, LOAD_AUDIT, ddl
from tillroll.sources.tables import GOOGLE_SECOND_RAW, SET_KEY, FileSet, RevenueTables

SKIPPED = "SKIPPED"


class LoadRefused(ValueError):
    """The file's content does not pass the checks of the load."""


@dataclass(frozen=True)
class FileLoad:
    """One provider file to load."""

    provider: str
    region: str
    path: str
    file_tx_id: str
    load_tx_id: str = ""  # a new one per load if empty
    data_source: str = ""
    as_of: date = field(default_factory=lambda: datetime.now(timezone.utc).date())
    monitor_id: str | None = None
    required: tuple[str, ...] = ()  # raw columns that no row may lack
    most_rejects: int = 0
    expected_rows: int | None = None  # lines that the file must have, as its collection noted

    @property
    def data_file(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    @property
    def source(self) -> str:
        return self.data_source or f"{CHANNELS[self.provider][0]}_{self.region}"


@dataclass(frozen=True)
class LoadResult:
    status: str
    staged_rows: int = 0
    superseded: int = 0


def _record(tables: RevenueTables, load: FileLoad, status: str, staged: int | None) -> None:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = (load.file_tx_id, load.source, load.data_file, status, staged, now)
    event = tables.spark.createDataFrame([row], ddl(LOAD_AUDIT)).coalesce(1)
    tables.append("load_audit_log", event)


def load_file(tables: RevenueTables, load: FileLoad) -> LoadResult:
    """Load a file. A file already in the fact is skipped and its audit left as it is; its monitor is
    refreshed again, which overwrites the monitor's own partition."""
    load = replace(load, load_tx_id=load.load_tx_id or uuid.uuid4().hex)
    known = tables.audit().where(F.col("file_tx_id") == load.file_tx_id)
    if known.where(F.col("status") == LOADED_FACT).count() > 0:
        _refresh(tables, load)  # a load may have ended after the fact and before its monitor
        return LoadResult(SKIPPED)
    _record(tables, load, IN_PROGRESS, None)
    staged = None
    try:
        staged = _stage(tables, load)
        _record(tables, load, IN_PROGRESS, staged)
        status, superseded = _store(tables, load)
        if status == LOADED_FACT:
            _update_skus(tables, load)
        _record(tables, load, status, staged)
    except Exception:
        _record(tables, load, LOAD_ERROR, staged)
        raise
    _refresh(tables, load)
    return LoadResult(status, staged, superseded)


def _refresh(tables: RevenueTables, load: FileLoad) -> None:
    if load.monitor_id is not None:
        refresh_monitor(tables, load.monitor_id, load.provider, load.as_of)


def _stage(tables: RevenueTables, load: FileLoad) -> int:
    """Raw and typed rows of the file; returns how many were typed."""
    second = load.provider == "google" and load.region == "EMEA"
    raw = GOOGLE_SECOND_RAW if second else f"raw_{load.provider}"
    typed = f"typed_{load.provider}"
    landed, rejected = land_checked(
        tables.spark, load.provider, load.path, load.file_tx_id, load.load_tx_id, load.required
    )
    tables.replace_partition(raw, landed, file_tx_id=load.file_tx_id)
    tables.replace_partition("rejects", rejected, file_tx_id=load.file_tx_id)
    _guard(tables, load, raw)
    rows = TYPERS[load.provider](tables.read_file(raw, load.file_tx_id), load.region)
    tables.replace_partition(typed, rows, file_tx_id=load.file_tx_id)
    return tables.read_file(typed, load.file_tx_id).count()


def _guard(tables: RevenueTables, load: FileLoad, raw: str) -> None:
    """Refuse a file with too many rejected lines or another number of lines than its collection noted. The
    rejects stay in their table."""
    rejects = tables.read_file("rejects", load.file_tx_id).count()
    if rejects > load.most_rejects:
        raise LoadRefused(f"{load.file_tx_id}: {rejects} lines rejected, {load.most_rejects} allowed")
    if load.expected_rows is not None:
        lines = tables.read_file(raw, load.file_tx_id).count() + rejects
        if lines != load.expected_rows:
            raise LoadRefused(f"{load.file_tx_id}: {lines} lines, {load.expected_rows} expected")


def _store(tables: RevenueTables, load: FileLoad) -> tuple[str, int]:
    """Fact rows of the file in force; returns its status and how many files it replaced."""
    typed = tables.read_file(f"typed_{load.provider}", load.file_tx_id)
    channel = CHANNELS[load.provider][0]
    if load.provider == "apple":
        tables.replace_partition("apple_sales", to_apple_fact(typed), file_tx_id=load.file_tx_id)
        sales = sku_revenue(apple_sales_values(tables.read_file("apple_sales", load.file_tx_id)))
        tables.publish(tables.stage(channel, load.file_tx_id, None, sales))
        return LOADED_FACT, 0
    audit = tables.audit()
    if load.provider == "amazon" and superseding_files(audit, load.file_tx_id).limit(1).count() > 0:
        gone = tables.file_sets().where(F.col("file_tx_id") == load.file_tx_id)
        tables.publish(None, gone.select(*SET_KEY))
        return SUPERSEDED, 0
    rows = to_fact(load.provider, typed)
    staged = tables.stage(channel, load.file_tx_id, rows.sortWithinPartitions("utc_timestamp"), sku_revenue(store_sales(rows)))
    if load.provider != "amazon":
        tables.publish(staged)
        return LOADED_FACT, 0
    return LOADED_FACT, _supersede(tables, load, staged, audit)


def _supersede(tables: RevenueTables, load: FileLoad, staged: FileSet, audit: DataFrame) -> int:
    """Put the file in force and those it replaces out of force at once, then mark them in the audit."""
    replaced = superseded_files(audit, load.file_tx_id)
    tables.publish(staged, replaced.select(F.lit(staged.pmt_channel).alias("pmt_channel"), "file_tx_id"))
    open_files = audit.where(~F.col("status").eqNullSafe(F.lit(SUPERSEDED))).join(
        replaced, "file_tx_id", "left_semi"
    )
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    marked = {
        "status": F.lit(SUPERSEDED),
        "load_date_time": F.lit(now).cast("timestamp_ntz"),
    }
    columns = [marked.get(c, F.col(c)).alias(c) for c in LOAD_AUDIT]
    event = tables.append("load_audit_log", open_files.select(*columns).coalesce(1))
    return tables.read("load_audit_log").where(F.col("event_seq") == event).count()


def _update_skus(tables: RevenueTables, load: FileLoad) -> None:
    """Append the file's new SKUs, then those that revenue promotes.

    Earlier loads have classified the SKUs of earlier files, so new ones come from this file alone. Revenue
    comes from the ledger of sums per SKU and file, in which a reloaded file has replaced its sums and a
    superseded one has none: no earlier payment is read. `refresh_skus` does the same over the facts.
    """
    if load.provider == "direct_billing":
        return
    if load.provider == "apple":
        rows = tables.read_file("apple_sales", load.file_tx_id)
        tables.append("sku_log", classify_apple_skus(rows, tables.skus()))
    else:
        rows = tables.read_file("payments", load.file_tx_id)
        tables.append("sku_log", classify_payment_skus(rows, tables.skus()))
    tables.append("sku_log", promoted_skus(tables.skus(), tables.sku_sales()))
