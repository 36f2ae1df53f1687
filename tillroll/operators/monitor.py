"""Ingestion monitoring: how far each collected file got, layer by layer."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.clock import month_of
from tillroll.operators.files import LOADED_FACT, LOADED_FACT_IGNORED, SUPERSEDED
from tillroll.sources.schemas import MASTER

FILE_COLUMNS = (
    "data_source", "collection_type", "file_date", "data_file", "file_tx_id", "load_status",
)
DONE = (LOADED_FACT_IGNORED, SUPERSEDED)
COUNTS = (
    "files_collected",
    "records_audit_trail",
    "raw_file_count",
    "raw_transaction_count",
    "final_file_count",
    "final_transaction_count",
    "fact_file_count",
    "fact_transaction_count",
    "fact_recorded_file_count",
    "fact_recorded_transaction_count",
)


def collected_files(
    collection: DataFrame, load: DataFrame, config: DataFrame, mv_id: str, as_of: date
) -> DataFrame:
    """Files the monitor covers: of its source and type, inside its months, not a full dump."""
    rule = config.where((F.col("mv_id") == mv_id) & (F.col("mv_status") == "ENABLED")).select(
        F.col("data_source").alias("_source"),
        F.col("collection_type").alias("_type"),
        F.add_months(F.lit(as_of), -F.col("mv_range_in_months")).alias("_from"),
    )
    stamp = F.col("data_file_timestamp")
    candidates = collection.where(
        ~F.col("data_file").like("%full%") & (stamp <= F.lit(as_of).cast("timestamp_ntz"))
    ).withColumn("_prefix", F.split_part("data_source", F.lit("_"), F.lit(1)))
    covered = candidates.join(
        rule,
        (F.col("_prefix") == F.col("_source"))
        & (F.col("collection_type") == F.col("_type"))
        & (stamp >= F.col("_from").cast("timestamp_ntz")),
    )
    status = load.select("file_tx_id", F.col("status").alias("load_status"))
    return covered.join(status, "file_tx_id", "left").select(
        "file_tx_id",
        "data_source",
        "collection_type",
        "data_file",
        stamp.cast("date").alias("file_date"),
        "tx_row_count",
        "load_status",
    )


def layer_counts(layers: Sequence[DataFrame], out: str) -> DataFrame:
    """Rows per file over the tables of a layer, each counted before they are put together."""
    counted = [t.groupBy("file_tx_id").agg(F.count("*").alias("_rows")) for t in layers]
    both = counted[0]
    for more in counted[1:]:
        both = both.unionByName(more)
    return both.groupBy("file_tx_id").agg(F.sum("_rows").alias(out))


def _percent(part: Column, whole: Column) -> Column:
    """A share in percent; 0 when nothing was expected, NULL when that is unknown."""
    share = F.round(part * F.lit(100).cast("decimal(3,0)") / F.nullif(whole, F.lit(0)), 4)
    return F.when(whole == 0, F.lit(0.0)).otherwise(share.cast("double"))


def ingestion_monitor(
    files: DataFrame, raw: Sequence[DataFrame], typed: DataFrame, fact: DataFrame
) -> DataFrame:
    """One row per collected file with its counts per layer and its completeness.

    Every layer is counted once per file, the fact too, and joined to the files; the months'
    last loaded day is an aggregate, so no pairs of files are formed.
    """
    per_file = files.groupBy(*FILE_COLUMNS).agg(
        F.count("*").alias("_copies"), F.sum("tx_row_count").alias("_expected")
    )
    month = [F.col("data_source"), F.col("collection_type"), month_of(F.col("file_date"))]
    names = ["data_source", "collection_type", "_month"]
    last_loaded = (
        files.where(F.col("load_status") == LOADED_FACT)
        .groupBy(*[c.alias(n) for c, n in zip(month, names)])
        .agg(F.max("file_date").alias("_last_loaded"))
    )
    rows = (
        per_file.withColumn("_month", month[2])
        .join(last_loaded, names, "left")
        .join(layer_counts(raw, "_raw"), "file_tx_id", "left")
        .join(layer_counts([typed], "_typed"), "file_tx_id", "left")
        .join(layer_counts([fact], "_fact"), "file_tx_id", "left")
    )

    status = F.col("load_status")
    done = F.coalesce(status.isin(*DONE), F.lit(False))
    active = F.coalesce(~status.isin(*DONE), F.lit(False)) & F.col("_fact").isNotNull()
    pending = F.coalesce(~status.isin(LOADED_FACT, *DONE), F.lit(True))
    overtaken = pending & F.coalesce(F.col("file_date") < F.col("_last_loaded"), F.lit(False))
    other_layer = (
        F.coalesce("_raw", "_typed", "_fact").isNotNull() | done | overtaken
    )

    def once(test: Column) -> Column:
        return F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def rows_of(layer: str, test: Column | None = None) -> Column:
        seen = F.coalesce(F.col(layer) * F.col("_copies"), F.lit(0))
        return seen if test is None else F.when(test, seen).otherwise(F.lit(0))

    expected = F.col("_expected")
    known = F.coalesce(expected, F.lit(0))
    counts = {
        "files_collected": once(F.lit(True)),
        "records_audit_trail": F.when(other_layer, known).otherwise(expected),
        "raw_file_count": once(F.col("_raw").isNotNull()),
        "raw_transaction_count": rows_of("_raw"),
        "final_file_count": once(F.col("_typed").isNotNull()),
        "final_transaction_count": rows_of("_typed"),
        "fact_file_count": once(F.col("_fact").isNotNull()),
        "fact_transaction_count": rows_of("_fact"),
        "fact_recorded_file_count": once(active) + once(done) + once(overtaken),
        "fact_recorded_transaction_count": rows_of("_fact", active)
        + F.when(done, known).otherwise(F.lit(0))
        + F.when(overtaken, known).otherwise(F.lit(0)),
    }
    counted = rows.select(
        *FILE_COLUMNS, *[value.cast("bigint").alias(name) for name, value in counts.items()]
    )
    return with_ratios(counted)


def with_ratios(counted: DataFrame) -> DataFrame:
    """Overwritten rows and the two completeness percentages, from the counts."""
    whole = F.col("records_audit_trail")
    overwritten = F.when(
        F.col("fact_recorded_file_count") != F.col("files_collected"), F.lit(0)
    ).otherwise(F.col("final_transaction_count") - F.col("fact_transaction_count"))
    return (
        counted.withColumn("overwritten", overwritten.cast("bigint"))
        .withColumn("pct_fact", _percent(F.col("fact_transaction_count"), whole))
        .withColumn("variance", _percent(F.col("fact_recorded_transaction_count"), whole))
    )


def monitor_daily(per_file: DataFrame) -> DataFrame:
    """Level 1: the per-file monitor rolled up to source, type and day."""
    return with_ratios(
        per_file.groupBy("data_source", "collection_type", "file_date").agg(
            *[F.sum(c).alias(c) for c in COUNTS]
        )
    )


def master_rows(per_file: DataFrame, mv_id: str) -> DataFrame:
    """The per-file monitor as rows of the master table."""
    tagged = per_file.withColumn("mv_id", F.lit(mv_id))
    return tagged.select(*[F.col(n).cast(kind).alias(n) for n, kind in MASTER.items()])


def master_stats(master: DataFrame) -> DataFrame:
    """First day, last day and size of each monitor in the master, in one pass."""
    return master.groupBy("mv_id").agg(
        F.min("file_date").alias("mv_min_date"),
        F.max("file_date").alias("mv_max_date"),
        F.count("*").alias("mv_row_count"),
    )


def stamp_config(config: DataFrame, master: DataFrame, mv_id: str, now: Column) -> DataFrame:
    """The config row of a monitor with the master's numbers and the time of the run."""
    stats = master_stats(master.where(F.col("mv_id") == mv_id))
    old = [c for c in config.columns if c not in ("mv_min_date", "mv_max_date", "mv_row_count")]
    stamped = config.where(F.col("mv_id") == mv_id).select(*old).join(stats, "mv_id", "left")
    fresh = {
        "mv_created_timestamp": now,
        "mv_updated_timestamp": now,
        "mv_row_count": F.coalesce("mv_row_count", F.lit(0).cast("bigint")),
    }
    return stamped.select(*[fresh.get(c, F.col(c)).alias(c) for c in config.columns])
