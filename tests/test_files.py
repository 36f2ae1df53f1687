from datetime import datetime

from tillroll.operators.facts import replace_file, without_files
from tillroll.operators.files import (
    all_superseded,
    current_audit,
    mark_superseded,
    superseded_files,
    superseding_files,
)
from tillroll.sources.schemas import LOAD_AUDIT, ddl

FILES = {
    "d5": "amazon_go_sales_2024-01-05.csv",
    "d15": "amazon_go_sales_2024-01-15.csv",
    "d20": "amazon_go_sales_2024-01-20.csv",
    "month": "amazon_go_sales_2024-01.csv",
    "feb": "amazon_go_sales_2024-02-01.csv",
    "other": "amazon_dplay_sales_2024-01-01.csv",
    "short": "amazon_go_sales_2024-01-7.csv",
    "refunds": "amazon_go_refunds_2024-01-01.csv",
}


def audit(spark, files=FILES, source="Amazon_GO", status="LOADED_FACT"):
    rows = [(i, source, name, status, None, datetime(2024, 1, 1)) for i, name in files.items()]
    return spark.createDataFrame(rows, ddl(LOAD_AUDIT))


def ids(df):
    return sorted(r.file_tx_id for r in df.collect())


def test_a_day_file_replaces_earlier_days_and_the_month_file(spark):
    assert ids(superseded_files(audit(spark), "d15")) == ["d5", "month", "short"]


def test_a_month_file_replaces_nothing(spark):
    assert ids(superseded_files(audit(spark), "month")) == []


def test_an_unpadded_day_is_shorter_and_loses(spark):
    assert ids(superseded_files(audit(spark), "short")) == ["month"]


def test_only_amazon_sales_files_count(spark):
    assert ids(superseded_files(audit(spark, source="Google_GO"), "d15")) == []
    # `_` in the source pattern stands for any one character.
    assert ids(superseded_files(audit(spark, source="Amazon"), "d15")) == []
    assert ids(superseded_files(audit(spark, source="amazonXgo"), "d15")) == ["d5", "month", "short"]


def test_newer_files_that_are_loaded(spark):
    assert ids(superseding_files(audit(spark), "d15")) == ["d20"]
    assert ids(superseding_files(audit(spark, status="LOAD_ERROR"), "d15")) == []


def test_all_superseded_agrees_with_file_by_file(spark):
    one_by_one = set()
    for incoming in FILES:
        one_by_one |= set(ids(superseded_files(audit(spark), incoming)))
    assert ids(all_superseded(audit(spark))) == sorted(one_by_one)


def test_marking_and_removing(spark):
    gone = all_superseded(audit(spark))
    marked = {r.file_tx_id: r.status for r in mark_superseded(audit(spark), gone).collect()}
    assert {f for f, s in marked.items() if s == "SUPERSEDED"} == set(ids(gone))
    facts = spark.createDataFrame([(i, 1) for i in FILES], "file_tx_id string, n int")
    assert ids(without_files(facts, gone)) == sorted(set(FILES) - set(ids(gone)))


def test_reloading_a_file_changes_nothing(spark):
    rows = [("a", 1), ("a", 1), ("b", 2), (None, 3)]
    facts = spark.createDataFrame(rows, "file_tx_id string, n int")
    again = replace_file(replace_file(facts, facts, "a"), facts, "a")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(rows, key=str)


def test_the_last_audit_event_counts(spark):
    events = [
        ("a", "S", "f", "IN_PROGRESS", None, datetime(2024, 1, 1), 1),
        ("a", "S", "f", "LOADED_FACT", 5, datetime(2024, 1, 1), 2),
        ("b", "S", "f", "LOAD_ERROR", None, datetime(2024, 1, 2), 3),
    ]
    log = spark.createDataFrame(events, ddl({**LOAD_AUDIT, "event_seq": "bigint"}))
    now = {r.file_tx_id: (r.status, r.record_count_staging) for r in current_audit(log).collect()}
    assert now == {"a": ("LOADED_FACT", 5), "b": ("LOAD_ERROR", None)}


def test_a_failed_file_replaces_nothing(spark):
    from tillroll.operators.files import all_superseded

    rows = [
        ("a", "Amazon_GO", "x_go_sales_2024-01-05.csv", "LOADED_FACT"),
        ("b", "Amazon_GO", "x_go_sales_2024-01-09.csv", "LOAD_ERROR"),
        ("c", "Amazon_GO", "x_go_sales_2024-02-05.csv", "LOADED_FACT"),
        ("d", "Amazon_GO", "x_go_sales_2024-02-09.csv", "LOADED_FACT"),
    ]
    df = spark.createDataFrame(rows, "file_tx_id string, data_source string, data_file string, status string")
    assert [r.file_tx_id for r in all_superseded(df).collect()] == ["c"]
