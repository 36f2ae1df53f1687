"""Provider files: load audit, reload guard and month-to-date supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ordered import latest

IN_PROGRESS = "IN_PROGRESS"
LOADED_FACT = "LOADED_FACT"
LOAD_ERROR = "LOAD_ERROR"
SUPERSEDED = "SUPERSEDED"
LOADED_FACT_IGNORED = "LOADED_FACT_IGNORED"


def current_audit(log: DataFrame) -> DataFrame:
    """The audit as it stands: the last event of each file in the append-only log."""
    newest = [F.col("load_date_time").desc(), F.col("event_seq").desc()]
    return latest(log, ["file_tx_id"], newest).drop("event_seq")


def staged_counts(typed: DataFrame) -> DataFrame:
    """Rows staged per file."""
    return typed.groupBy("file_tx_id").agg(F.count("*").alias("record_count_staging"))


def with_staged_counts(audit: DataFrame, typed: DataFrame) -> DataFrame:
    """The audit with the staged row count of every file that `typed` holds."""
    counts = staged_counts(typed).withColumnRenamed("record_count_staging", "_staged")
    columns = [
        F.coalesce("_staged", "record_count_staging").alias(c) if c == "record_count_staging" else c
        for c in audit.columns
    ]
    return audit.join(counts, "file_tx_id", "left").select(*columns)


def month_to_date_files(audit: DataFrame) -> DataFrame:
    """Amazon sales files with their month key and their place in the month.

    The name reads `x_{realm}_{type}_{YYYY-MM-DD}.ext`. The place compares by the length of the day
    token first and its text second, so a file without a day, or with an unpadded one, comes first.
    """
    name = F.col("data_file")
    day_text = F.split_part(F.split_part(name, F.lit("_"), F.lit(4)), F.lit("."), F.lit(1))

    def dashed(n: int) -> Column:
        return F.split_part(day_text, F.lit("-"), F.lit(n))

    month_key = F.concat(
        F.split_part(name, F.lit("_"), F.lit(2)),
        F.split_part(name, F.lit("_"), F.lit(3)),
        dashed(1),
        dashed(2),
    )
    sales = F.col("data_source").ilike("Amazon_%") & F.lower(name).like("%sales%")
    return audit.where(sales).select(
        "file_tx_id",
        "status",
        month_key.alias("realm_month_key"),
        F.struct(F.length(dashed(3)).alias("width"), dashed(3).alias("day")).alias("place"),
    )


def superseded_files(audit: DataFrame, incoming_id: str) -> DataFrame:
    """Files that the incoming one replaces: same realm, type and month, an earlier place."""
    files = month_to_date_files(audit)
    incoming = files.where(F.col("file_tx_id") == incoming_id).select(
        "realm_month_key", F.col("place").alias("incoming_place")
    )
    return (
        files.join(incoming, "realm_month_key")
        .where(F.col("place") < F.col("incoming_place"))
        .select("file_tx_id")
    )


def superseding_files(audit: DataFrame, incoming_id: str) -> DataFrame:
    """Loaded files that already replace the incoming one, which then must not enter the fact."""
    loaded = (F.col("status") == LOADED_FACT) | (F.col("file_tx_id") == incoming_id)
    files = month_to_date_files(audit.where(loaded))
    incoming = files.where(F.col("file_tx_id") == incoming_id).select(
        "realm_month_key", F.col("place").alias("incoming_place")
    )
    return (
        files.join(incoming, "realm_month_key")
        .where(F.col("place") > F.col("incoming_place"))
        .select("file_tx_id")
    )


def all_superseded(audit: DataFrame) -> DataFrame:
    """Every file that some file of the same realm, type and month replaces.

    Only a file that reached the fact replaces others; one that failed or is still loading does not.
    The last place of each month is one aggregate, so no pairs of files are formed.
    """
    files = month_to_date_files(audit)
    reached = files.where(F.col("status").isin(LOADED_FACT, SUPERSEDED))
    last = reached.groupBy("realm_month_key").agg(F.max("place").alias("last_place"))
    return (
        files.join(last, "realm_month_key")
        .where(F.col("place") < F.col("last_place"))
        .select("file_tx_id", "realm_month_key", F.col("place.day").alias("day_of_month"))
    )


def mark_superseded(audit: DataFrame, files: DataFrame) -> DataFrame:
    """The audit with status SUPERSEDED on the given files."""
    marked = files.select("file_tx_id").distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone"), F.lit(SUPERSEDED)).otherwise(F.col("status"))
    return audit.join(marked, "file_tx_id", "left").select(
        *[status.alias(c) if c == "status" else c for c in audit.columns]
    )
