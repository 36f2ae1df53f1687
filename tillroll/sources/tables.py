"""Parquet tables of the revenue database.

Plain parquet has no row updates and no transactions, so state is kept in ways that survive a lost job:

* raw and typed tables are partitioned by file, and a load overwrites the file's own partition;
* payments and SKU sales are partitioned by file and generation. A load writes a generation that nobody
  reads yet; one appended file of the `file_sets_log` then puts it in force and takes the files that it
  replaces out of force, so that readers see both or neither. The view `payments` resolves this;
* closed months lie in few large files, sorted by provider file (`close_month`). The copy is written first,
  and one appended file then says for all its provider files that their payments are there;
* the audit, the SKU reference, the monitor config and the file sets are append-only logs whose last row
  per key counts. A log has epochs: compaction copies the last rows to a new one, and one row of
  `log_heads` lets readers begin there. Nothing is ever rewritten from itself.
"""

from __future__ import annotations

import time
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.files import current_audit
from tillroll.operators.ordered import latest
from tillroll.sources.schemas import (
    COLLECTION_AUDIT,
    FILE_SETS,
    LOAD_AUDIT,
    LOG_HEADS,
    MASTER,
    MONITOR_CONFIG,
    PAYMENTS,
    PROVIDERS,
    PSP_CHARGES,
    PSP_PAYMENTS,
    RECON_DETAIL,
    REJECTS,
    SKU_KEY,
    SKU_SALES,
    SKUS,
    SUBSCRIBER_BITMAPS,
    ddl,
    raw_schema,
    typed_schema,
)

GOOGLE_SECOND_RAW = "raw_google_emea"
SET_KEY = ("pmt_channel", "file_tx_id")
NO_GENERATION = -1
CLOSED_FILES = 8  # of a small closed month
CLOSED_FILE_ROWS = 250_000  # of a large one
# The logs and the keys whose last row counts.
LOGS = {
    "load_audit_log": (LOAD_AUDIT, ("file_tx_id",)),
    "sku_log": (SKUS, SKU_KEY),
    "monitor_config_log": (MONITOR_CONFIG, ("mv_id",)),
    "file_sets_log": (FILE_SETS, SET_KEY),
}


def table_schemas() -> dict[str, tuple[dict[str, str], tuple[str, ...]]]:
    """Columns and partition columns of every table."""
    tables = {}
    for provider in PROVIDERS:
        tables[f"raw_{provider}"] = (raw_schema(provider), ("file_tx_id",))
        tables[f"typed_{provider}"] = (typed_schema(provider), ("file_tx_id",))
    tables[GOOGLE_SECOND_RAW] = (raw_schema("google"), ("file_tx_id",))
    tables["payments_store"] = ({**PAYMENTS, "generation": "bigint"}, (*SET_KEY, "generation"))
    closed = {c: kind for c, kind in PAYMENTS.items() if c != "pmt_channel"}
    tables["payments_closed"] = ({**closed, "pmt_channel": PAYMENTS["pmt_channel"], "stored": "bigint"}, ("pmt_channel", "stored"))
    tables["sku_sales"] = (SKU_SALES, ("file_tx_id", "generation"))
    tables["apple_sales"] = (typed_schema("apple"), ("file_tx_id",))
    tables["rejects"] = (REJECTS, ("file_tx_id",))
    run = {"provider": "string", "run_day": "date"}
    for name, columns in (("detail", RECON_DETAIL), ("open_payments", PSP_PAYMENTS), ("open_charges", PSP_CHARGES)):
        tables[f"recon_{name}"] = ({**columns, **run}, tuple(run))
    tables["recon_runs"] = (run, ())
    tables["collection_audit"] = (COLLECTION_AUDIT, ())
    for log, (columns, _) in LOGS.items():
        tables[log] = ({**columns, "event_seq": "bigint", "epoch": "bigint"}, ("epoch",))
    tables["log_heads"] = (LOG_HEADS, ())
    tables["ingestion_master"] = (MASTER, ("mv_id",))
    tables["subscriber_bitmaps"] = (SUBSCRIBER_BITMAPS, ("as_of",))
    return tables


def _literal(value: str | int | date) -> str:
    if isinstance(value, int):
        return str(value)
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class FileSet(NamedTuple):
    """A generation of a file that is written and not yet in force."""

    pmt_channel: str
    file_tx_id: str
    generation: int


class RevenueTables:
    """The tables of one database."""

    def __init__(self, spark: SparkSession, database: str = "tillroll"):
        self.spark = spark
        self.database = database
        self.schemas = table_schemas()

    def create(self) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
        for name, (columns, parts) in self.schemas.items():
            by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name(name)} ({ddl(columns)}) USING parquet{by}"
            )
        head = f"SELECT max_by(read_from, event_seq) FROM {self.name('log_heads')} WHERE log = 'file_sets_log'"
        self.spark.sql(
            f"""CREATE OR REPLACE VIEW {self.name('payments')} AS
            SELECT {', '.join(PAYMENTS)} FROM (
              SELECT {', '.join(PAYMENTS)}, generation AS stored FROM {self.name('payments_store')}
              UNION ALL SELECT {', '.join(PAYMENTS)}, stored FROM {self.name('payments_closed')})
            LEFT SEMI JOIN (
              SELECT pmt_channel, file_tx_id, at.stored FROM (
                SELECT pmt_channel, file_tx_id, max_by(struct(generation, stored), event_seq) AS at
                FROM {self.name('file_sets_log')} WHERE epoch >= coalesce(({head}), 0)
                GROUP BY pmt_channel, file_tx_id) WHERE at.generation > {NO_GENERATION})
            USING (pmt_channel, file_tx_id, stored)"""
        )

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def read(self, table: str) -> DataFrame:
        """The table, with its columns in schema order. Of a log, the epochs that count."""
        if table == "payments":
            return self.payments()
        rows = self.spark.table(self.name(table)).select(*self.schemas[table][0])
        if table in LOGS:
            return rows.where(F.col("epoch") >= self._head(table, "read_from")).drop("epoch")
        return rows

    def read_file(self, table: str, file_tx_id: str) -> DataFrame:
        """The rows of one file; only its partition is scanned."""
        return self.read(table).where(F.col("file_tx_id") == file_tx_id)

    def replace_partition(self, table: str, rows: DataFrame, **spec: str | int | date) -> None:
        """Overwrite one partition, also when there are no rows. Running it twice is harmless."""
        columns, parts = self.schemas[table]
        if set(spec) != set(parts):
            raise ValueError(f"{table} is partitioned by {parts}")
        values = ", ".join(f"`{k}` = {_literal(v)}" for k, v in spec.items())
        plain = ", ".join(f"`{c}`" for c in columns if c not in spec)
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.name(table)} PARTITION ({values}) "
            f"SELECT {plain} FROM {{rows}}",
            rows=rows,
        )

    def renew_partition(self, table: str, rows: DataFrame, **spec: str | int | date) -> None:
        """Drop one partition and write it anew from rows that may come from other partitions of the table.
        Running it twice is harmless; whoever reads the partition must know by other means that it is whole."""
        self.drop_partition(table, **spec)
        values = {k: F.lit(v).cast(self.schemas[table][0][k]) for k, v in spec.items()}
        rows.withColumns(values).select(*self.schemas[table][0]).write.insertInto(self.name(table))

    def drop_partition(self, table: str, **spec: str | int | date) -> None:
        values = ", ".join(f"`{k}` = {_literal(v)}" for k, v in spec.items())
        self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({values})")

    def append(self, table: str, rows: DataFrame) -> int:
        """Add rows; a log's rows get the event number that is returned."""
        columns = self.schemas[table][0]
        event = time.time_ns()
        if "event_seq" in columns:
            rows = rows.withColumn("event_seq", F.lit(event).cast("bigint"))
        if table in LOGS:
            rows = rows.withColumn("epoch", self._head(table, "write_epoch"))
        rows.select(*columns).write.insertInto(self.name(table))
        return event

    # Payments and SKU sales by generation.

    def file_sets(self) -> DataFrame:
        """What of each file is in force."""
        rest = [c for c in FILE_SETS if c not in SET_KEY]
        newest = F.max_by(F.struct(*rest), "event_seq").alias("_set")
        sets = self.read("file_sets_log").groupBy(*SET_KEY).agg(newest)
        return sets.select(*SET_KEY, *[F.col("_set")[c].alias(c) for c in rest])

    def payments(self, first: date | Column | None = None, last: date | Column | None = None) -> DataFrame:
        """The payments in force. With days, only files are opened that hold some between them, both
        included; the rows are not filtered."""
        sets = self.file_sets().where(F.col("generation") > NO_GENERATION)
        if first is not None:
            sets = sets.where(F.col("last_day") >= F.lit(first))
        if last is not None:
            sets = sets.where(F.col("first_day") <= F.lit(last))
        keys = [*SET_KEY, "stored"]
        return self._all_payments().join(sets.select(*keys), keys, "left_semi").select(*PAYMENTS)

    def _all_payments(self) -> DataFrame:
        """Payments of all generations and closings, each with the place where it is stored."""
        store = self.spark.table(self.name("payments_store")).withColumnRenamed("generation", "stored")
        closed = self.spark.table(self.name("payments_closed"))
        return store.select(*PAYMENTS, "stored").unionByName(closed.select(*PAYMENTS, "stored"))

    def sku_sales(self) -> DataFrame:
        """Revenue per SKU and file, of the files in force."""
        sets = self.file_sets().where(F.col("generation") > NO_GENERATION)
        keys = ["file_tx_id", "generation"]
        return self.read("sku_sales").join(sets.select(*keys), keys, "left_semi").select(*SKU_SALES)

    def stage(self, channel: str, file_tx_id: str, payments: DataFrame | None, sales: DataFrame) -> FileSet:
        """Write a file's payments (None where the channel has a fact of its own) and SKU sales as a
        generation of its own, which no reader sees before `publish`."""
        staged = FileSet(channel, file_tx_id, time.time_ns())
        if payments is not None:
            self.replace_partition("payments_store", payments, **staged._asdict())
        self.replace_partition("sku_sales", sales, file_tx_id=file_tx_id, generation=staged.generation)
        return staged

    def publish(self, staged: FileSet | None, gone: DataFrame | None = None) -> None:
        """Put a staged file in force and take the files `gone` (pmt_channel, file_tx_id) out of force, in one
        appended file: readers see all of it or nothing."""
        events = []
        if staged is not None:
            store = self.spark.table(self.name("payments_store"))
            own = store.where(
                (F.col("pmt_channel") == staged.pmt_channel)
                & (F.col("file_tx_id") == staged.file_tx_id)
                & (F.col("generation") == staged.generation)
            )
            events.append(
                own.agg(F.min("utc_date").alias("first_day"), F.max("utc_date").alias("last_day"), F.count("*").alias("file_rows")).select(
                    F.lit(staged.pmt_channel).alias("pmt_channel"),
                    F.lit(staged.file_tx_id).alias("file_tx_id"),
                    F.lit(staged.generation).alias("generation"),
                    F.lit(staged.generation).alias("stored"),
                    "first_day",
                    "last_day",
                    "file_rows",
                )
            )
        if gone is not None:
            none = {c: F.lit(None).cast(kind) for c, kind in FILE_SETS.items()}
            none["generation"] = F.lit(NO_GENERATION)
            events.append(gone.distinct().select(*[F.col(c) if c in SET_KEY else none[c].alias(c) for c in FILE_SETS]))
        rows = events[0]
        for more in events[1:]:
            rows = rows.unionByName(more)
        self.append("file_sets_log", rows.coalesce(1))

    def close_month(self, month: date, files: int | None = None) -> int:
        """Rewrite the payments of a closed month into `files` files a channel at most, sorted by provider file.
        Without a number, there are CLOSED_FILES, or as many as hold CLOSED_FILE_ROWS payments each.

        These are the files in force whose last payment is of the month of this day. The copy is complete before one
        appended file points to it, so a job that dies leaves every answer as it was. A later file that
        replaces a closed one takes it out of force as before; reading one file skips the row groups of the
        others. Files are cut by range of file and time, so a large file is spread over several tasks.
        Returns how many provider files were moved. Run it while no load runs, then `vacuum`.
        """
        sets = self.file_sets().where(
            (F.col("generation") > NO_GENERATION)
            & (F.col("stored") == F.col("generation"))
            & (F.trunc("last_day", "MM") == F.trunc(F.lit(month), "MM"))
        )
        moved, rows = sets.agg(F.count("*"), F.coalesce(F.sum("file_rows"), F.lit(0))).first()
        if moved == 0:
            return 0
        files = files or max(CLOSED_FILES, -(-rows // CLOSED_FILE_ROWS))
        closing = time.time_ns()
        keys = [*SET_KEY, "stored"]
        store = self.spark.table(self.name("payments_store")).withColumnRenamed("generation", "stored")
        own = store.join(sets.select(*keys), keys, "left_semi").withColumn("stored", F.lit(closing).cast("bigint"))
        order = ("pmt_channel", "file_tx_id", "utc_timestamp")
        ranged = own.repartitionByRange(files, *order).sortWithinPartitions(*order)
        ranged.select(*self.schemas["payments_closed"][0]).write.insertInto(self.name("payments_closed"))
        written = self.spark.table(self.name("payments_closed")).where(F.col("stored") == closing).count()
        if written != rows:
            raise RuntimeError(f"closing {month:%Y-%m}: {written} payments copied of {rows}")
        self.append("file_sets_log", sets.withColumn("stored", F.lit(closing).cast("bigint")).coalesce(1))
        return moved

    def vacuum(self, before: int) -> int:
        """Drop the generations written before this time (ns) that are not in force: replaced ones, those of
        loads that died, those that a closing has taken in, and closings of which no file is in force. Choose
        a time before which no reader or load has begun that still runs."""
        sets = self.file_sets().where(F.col("generation") > NO_GENERATION)
        parts = {
            "payments_store": ([*SET_KEY, "generation"], [*SET_KEY, F.col("stored").alias("generation")]),
            "sku_sales": (["file_tx_id", "generation"], ["file_tx_id", "generation"]),
            "payments_closed": (["pmt_channel", "stored"], ["pmt_channel", "stored"]),
        }
        dropped = 0
        for table, (keys, in_force) in parts.items():
            held = self.spark.table(self.name(table)).select(*keys).distinct().where(F.col(keys[-1]) < before)
            for row in held.join(sets.select(*in_force), keys, "left_anti").toLocalIterator():
                self.drop_partition(table, **row.asDict())
                dropped += 1
        return dropped

    # Logs.

    def _head(self, log: str, which: str) -> Column:
        """An epoch of the log's head, looked up when the query runs."""
        heads = self.spark.table(self.name("log_heads")).where(F.col("log") == log)
        return heads.agg(F.coalesce(F.max_by(which, "event_seq"), F.lit(0)).cast("bigint")).scalar()

    def compact(self, log: str, files: int = 1) -> None:
        """Copy the last row per key to a new epoch of `files` files and let readers begin there.

        First the new epoch is opened: what is appended from now on goes there, and readers read both. The
        copies keep their event numbers, so while both are read, and after a job that died here, every
        answer is the same as before. Then readers switch, and older epochs are dropped but for those
        that running readers may be in. Run one compaction of a log at a time, with no load running.
        """
        columns, keys = LOGS[log]
        epochs = self.spark.table(self.name("log_heads")).where(F.col("log") == log)
        read_from, epoch = epochs.agg(
            F.coalesce(F.max_by("read_from", "event_seq"), F.lit(0)), F.coalesce(F.max_by("write_epoch", "event_seq"), F.lit(0))
        ).first()
        self._turn(log, read_from, epoch + 1)
        kept = latest(self.read(log), list(keys), self._newest(log))
        copy = kept.withColumn("epoch", F.lit(epoch + 1).cast("bigint")).select(*self.schemas[log][0])
        copy.repartition(files).write.insertInto(self.name(log))
        self._turn(log, epoch + 1, epoch + 1)
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name(log)}").toLocalIterator():
            old = int(row.partition.removeprefix("epoch="))
            if old < read_from:
                self.drop_partition(log, epoch=old)

    def _turn(self, log: str, read_from: int, write_epoch: int) -> None:
        row = (log, read_from, write_epoch, 0)
        self.append("log_heads", self.spark.createDataFrame([row], ddl(LOG_HEADS)).coalesce(1))

    def _newest(self, log: str) -> list[Column]:
        if log == "load_audit_log":
            return [F.col("load_date_time").desc(), F.col("event_seq").desc()]
        return [F.col("event_seq").desc()]

    def audit(self) -> DataFrame:
        """The load audit as it stands."""
        return current_audit(self.read("load_audit_log"))

    def skus(self) -> DataFrame:
        """The SKU reference as it stands."""
        return latest(self.read("sku_log"), list(SKU_KEY), self._newest("sku_log")).drop("event_seq")

    def monitor_config(self) -> DataFrame:
        """The monitor config as it stands."""
        log = self.read("monitor_config_log")
        return latest(log, ["mv_id"], self._newest("monitor_config_log")).drop("event_seq")
