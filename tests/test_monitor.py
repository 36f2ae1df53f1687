from datetime import date, datetime

from pyspark.sql import functions as F

from tillroll.operators.monitor import (
    collected_files,
    ingestion_monitor,
    master_rows,
    master_stats,
    monitor_daily,
    stamp_config,
)
from tillroll.sources.schemas import COLLECTION_AUDIT, LOAD_AUDIT, MASTER, MONITOR_CONFIG, ddl

AS_OF = date(2024, 3, 1)
ENABLED = ("m", "ENABLED", "Google", "SALES", 2, None, None, None, None, None)


def frames(spark, collected, loaded, config=(ENABLED,)):
    return (
        spark.createDataFrame(
            [(i, "Google_AMER", "SALES", f"{i}.csv", datetime.combine(d, datetime.min.time()), n)
             for i, d, n in collected],
            ddl(COLLECTION_AUDIT),
        ),
        spark.createDataFrame(
            [(i, "Google_AMER", f"{i}.csv", s, None, None) for i, s in loaded.items()],
            ddl(LOAD_AUDIT),
        ),
        spark.createDataFrame(list(config), ddl(MONITOR_CONFIG)),
    )


def layer(spark, counts):
    return spark.createDataFrame([(i,) for i, n in counts.items() for _ in range(n)], "file_tx_id string")


def monitor(spark, collected, loaded, raw, typed, fact, second=None):
    files = collected_files(*frames(spark, collected, loaded), "m", AS_OF)
    raws = [layer(spark, raw)] + ([layer(spark, second)] if second else [])
    out = ingestion_monitor(files, raws, layer(spark, typed), layer(spark, fact))
    return {r.file_tx_id: r for r in out.collect()}


def test_which_files_are_covered(spark):
    days = {
        "old": date(2023, 12, 31), "first": date(2024, 1, 1), "last": AS_OF, "later": date(2024, 3, 2),
        "x_full_x": date(2024, 2, 1), "x_FULL_x": date(2024, 2, 1),
    }
    collected = [(i, d, 1) for i, d in days.items()]
    files = collected_files(*frames(spark, collected, {"first": "LOADED_FACT"}), "m", AS_OF)
    got = {r.file_tx_id: r.load_status for r in files.collect()}
    assert got == {"first": "LOADED_FACT", "last": None, "x_FULL_x": None}


def test_a_disabled_monitor_covers_nothing(spark):
    off = ("m", "DISABLED", *ENABLED[2:])
    files = collected_files(
        *frames(spark, [("a", date(2024, 2, 1), 1)], {}, config=[off]), "m", AS_OF
    )
    assert files.count() == 0


def test_the_states_of_a_file(spark):
    day = [date(2024, 2, n) for n in range(1, 10)]
    rows = monitor(
        spark,
        [("loaded", day[5], 10), ("replaced", day[0], 8), ("ignored", day[0], 7),
         ("pending", day[1], 6), ("after", day[6], 5), ("unknown", day[1], None),
         ("lost", day[7], None), ("empty", day[7], 0), ("other_month", date(2024, 1, 2), 4)],
        {"loaded": "LOADED_FACT", "replaced": "SUPERSEDED", "ignored": "LOADED_FACT_IGNORED",
         "pending": "IN_PROGRESS", "after": "IN_PROGRESS"},
        raw={"loaded": 10, "replaced": 8, "pending": 6, "unknown": 3},
        typed={"loaded": 10, "replaced": 8},
        fact={"loaded": 9},
    )
    loaded, replaced = rows["loaded"], rows["replaced"]
    assert (loaded.fact_recorded_file_count, loaded.overwritten) == (1, 1)
    assert (loaded.pct_fact, loaded.variance) == (90.0, 90.0)
    assert (replaced.fact_recorded_file_count, replaced.overwritten) == (1, 8)
    assert (replaced.pct_fact, replaced.variance) == (0.0, 100.0)
    assert rows["ignored"].variance == 100.0
    # Overtaken by the loaded file of the same month, counted once however many there are.
    assert (rows["pending"].fact_recorded_transaction_count, rows["pending"].variance) == (6, 100.0)
    assert (rows["after"].fact_recorded_file_count, rows["after"].variance) == (0, 0.0)
    assert rows["other_month"].variance == 0.0
    # An unknown size is 0 once any other layer has the file, and stays unknown otherwise.
    assert (rows["unknown"].records_audit_trail, rows["unknown"].pct_fact) == (0, 0.0)
    assert (rows["lost"].records_audit_trail, rows["lost"].pct_fact) == (None, None)
    assert rows["empty"].pct_fact == 0.0


def test_both_raw_regions_count(spark):
    rows = monitor(
        spark, [("a", date(2024, 2, 1), 5)], {"a": "LOADED_FACT"},
        raw={"a": 2}, second={"a": 3}, typed={"a": 5}, fact={"a": 5},
    )
    assert (rows["a"].raw_file_count, rows["a"].raw_transaction_count) == (1, 5)


def test_daily_rollup_and_master(spark):
    collected = [("a", date(2024, 2, 1), 4), ("b", date(2024, 2, 1), 6), ("c", date(2024, 2, 2), 1)]
    loaded = dict.fromkeys("abc", "LOADED_FACT")
    files = collected_files(*frames(spark, collected, loaded), "m", AS_OF)
    counts = layer(spark, {"a": 4, "b": 3, "c": 1})
    per_file = ingestion_monitor(files, [counts], counts, counts)
    daily = {r.file_date.day: r for r in monitor_daily(per_file).collect()}
    assert (daily[1].files_collected, daily[1].pct_fact) == (2, 70.0)
    master = master_rows(per_file, "m")
    assert {f.name: f.dataType.simpleString() for f in master.schema} == MASTER
    (stats,) = master_stats(master).collect()
    assert (stats.mv_row_count, stats.mv_min_date, stats.mv_max_date) == (
        3, date(2024, 2, 1), date(2024, 2, 2),
    )
    config = spark.createDataFrame([ENABLED], ddl(MONITOR_CONFIG))
    now = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    (stamped,) = stamp_config(config, master, "m", now).collect()
    assert (stamped.mv_row_count, stamped.mv_range_in_months) == (3, 2)
    (empty,) = stamp_config(config, master.where("false"), "m", now).collect()
    assert (empty.mv_row_count, empty.mv_min_date) == (0, None)
