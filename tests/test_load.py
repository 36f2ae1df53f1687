"""Loading files end to end: landing, fact, supersession, SKUs, monitor, audit."""

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tillroll.operators.accrual import AccrualLookups
from tillroll.plans.load import FileLoad, load_file
from tillroll.plans.refresh import Layers, monitor_of, refresh_accrual, refresh_skus
from tillroll.operators.skus import sku_revenue, store_sales
from tillroll.sources.schemas import COLLECTION_AUDIT, MONITOR_CONFIG, PAYMENTS, ddl, raw_widths
from tillroll.sources.tables import LOGS, RevenueTables
from tillroll_checks.loads import _written

AS_OF = date(2024, 3, 1)


def write_file(folder, name, provider, rows, sep=","):
    """A provider file with the given fields set and the others empty."""
    columns = list(raw_widths(provider))
    lines = [sep.join(columns)]
    lines += [sep.join(str(row.get(c, "")) for c in columns) for row in rows]
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def amazon_row(n, sku="go.plan.annual", price="9.99", kind="Charge", item="Subscription", day=5):
    return {
        "marketplace": "amazon.com",
        "country_region_code": "US",
        "transaction_id": f"t{n}",
        "transaction_time": f"2024-01-{day:02d} 12:00:00 UTC",
        "transaction_type": kind,
        "vendor_sku": sku,
        "item_type": item,
        "units": 1,
        "marketplace_currency": "USD",
        "sales_price_marketplace_currency": price,
        "estimated_earnings_marketplace_currency": "7.00",
        "receipt_id": f"r{n}",
    }


def amazon_file(folder, day, rows):
    name = f"amazon_go_sales_2024-01-{day:02d}.csv"
    return write_file(folder, name, "amazon", rows)


def amazon_load(path, file_id, **more):
    return FileLoad("amazon", "AMER", path, file_id, as_of=AS_OF, **more)


def statuses(tables):
    return {r.file_tx_id: r.status for r in tables.audit().collect()}


def fact_ids(tables):
    rows = tables.read("payments").select("file_tx_id", "transaction_id").collect()
    return sorted((r.file_tx_id, r.transaction_id) for r in rows)


def test_a_later_month_to_date_file_replaces_the_earlier_ones(tables, tmp_path):
    for day in (5, 15, 20):
        rows = [amazon_row(n, day=min(n, day)) for n in range(1, day + 1)]
        result = load_file(tables, amazon_load(amazon_file(tmp_path, day, rows), f"d{day}"))
        assert (result.status, result.staged_rows) == ("LOADED_FACT", day)
    assert {f for f, _ in fact_ids(tables)} == {"d20"}
    assert tables.read("payments").count() == 20
    assert statuses(tables) == {"d5": "SUPERSEDED", "d15": "SUPERSEDED", "d20": "LOADED_FACT"}
    assert {r.file_tx_id: r.record_count_staging for r in tables.audit().collect()} == {
        "d5": 5, "d15": 15, "d20": 20,
    }
    assert tables.read("payments").columns == list(PAYMENTS)


def test_an_earlier_file_that_comes_late_does_not_enter_the_fact(tables, tmp_path):
    load_file(tables, amazon_load(amazon_file(tmp_path, 20, [amazon_row(1)]), "d20"))
    late = load_file(tables, amazon_load(amazon_file(tmp_path, 5, [amazon_row(2)]), "d5"))
    assert late.status == "SUPERSEDED"
    assert fact_ids(tables) == [("d20", "t1")]
    assert statuses(tables)["d5"] == "SUPERSEDED"


def test_a_loaded_file_is_skipped_and_its_audit_kept(tables, tmp_path):
    path = amazon_file(tmp_path, 5, [amazon_row(1), amazon_row(2)])
    assert load_file(tables, amazon_load(path, "d5")).status == "LOADED_FACT"
    before = tables.read("load_audit_log").count()
    assert load_file(tables, amazon_load(path, "d5")).status == "SKIPPED"
    assert tables.read("load_audit_log").count() == before
    assert len(fact_ids(tables)) == 2


def test_a_failed_load_is_marked_and_can_be_repeated(tables, tmp_path):
    bad = amazon_file(tmp_path, 5, [amazon_row(1), {**amazon_row(2), "units": "1.5"}])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_file(tables, amazon_load(bad, "d5"))
    assert statuses(tables) == {"d5": "LOAD_ERROR"}
    assert fact_ids(tables) == []
    good = amazon_file(tmp_path, 5, [amazon_row(1), amazon_row(2)])
    assert load_file(tables, amazon_load(good, "d5")).status == "LOADED_FACT"
    assert load_file(tables, amazon_load(good, "d5")).status == "SKIPPED"
    assert len(fact_ids(tables)) == 2
    assert tables.read("typed_amazon").count() == 2


def store(tables, rows, file_id, channel="Amazon"):
    """Put payments in force as a load does."""
    staged = tables.stage(channel, file_id, rows, sku_revenue(store_sales(rows)))
    tables.publish(staged)


def test_partitions_are_replaced_also_by_nothing(tables, spark, tmp_path):
    path = amazon_file(tmp_path, 5, [amazon_row(1)])
    load_file(tables, amazon_load(path, "d5"))
    store(tables, spark.createDataFrame([], ddl(PAYMENTS)), "d5")
    assert tables.read("payments").count() == 0
    raw = spark.createDataFrame([], ddl(tables.schemas["raw_amazon"][0]))
    tables.replace_partition("raw_amazon", raw, file_tx_id="d5")
    assert tables.read("raw_amazon").count() == 0
    with pytest.raises(ValueError):
        tables.replace_partition("raw_amazon", raw)


def test_file_ids_with_quotes_are_safe(tables, tmp_path):
    path = amazon_file(tmp_path, 5, [amazon_row(1)])
    odd = "d'5\\x"
    load_file(tables, amazon_load(path, odd))
    assert fact_ids(tables) == [(odd, "t1")]


def test_skus_are_classified_once_and_promoted_on_revenue(tables, tmp_path):
    free = [amazon_row(1, sku="go.lite.month", price="0")]
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, free), "d5"))
    found = tables.skus().collect()
    assert [(r.sku_id, r.included_in_accrual_yn, r.tier_type) for r in found] == [
        ("go.lite.month", "N", "ad_lite")
    ]
    paid = free + [amazon_row(2, sku="go.lite.month"), amazon_row(3, sku="new.annual")]
    load_file(tables, amazon_load(amazon_file(tmp_path, 6, paid), "d6"))
    found = sorted((r.sku_id, r.included_in_accrual_yn) for r in tables.skus().collect())
    assert found == [("go.lite.month", "Y"), ("new.annual", "Y")]


def test_every_provider_loads(tables, tmp_path):
    apple = write_file(
        tmp_path, "apple.txt", "apple",
        [{"sku": "a.annual", "units": 2, "customer_price": "9.99", "begin_date": "1/5/2024",
          "end_date": "01/06/2024", "subscription": "New", "title": "app"}],
        sep="\t",
    )
    google = write_file(
        tmp_path, "google.csv", "google",
        [{"order_number": "GPA.1", "order_charged_date": "2024-01-05",
          "order_charged_timestamp": "2024-01-05 10:00:00", "financial_status": "Charged",
          "product_type": "subscription", "sku_id": "g.month", "amount_buyer_currency": "4.5",
          "amount_merchant_currency": "4"}],
    )
    roku = write_file(
        tmp_path, "roku.csv", "roku",
        [{"transaction_id": "r1", "product_id": "r.plan", "transaction_type": "Purchase",
          "transaction_date": "2024-01-05 10:00:00", "amount": "3.99", "currency": "USD"}],
    )
    billing = tmp_path / "billing.json"
    billing.write_text(
        '{"transaction_id": "b1", "amount": "1500", "currency": "KWD", "vat": "100", '
        '"charged_timestamp": "2024-01-05 10:00:00", "transaction_type": "CHARGE", '
        '"installment_details": {"number_of_installments": "3"}, "items": {"item_id": "it1"}, '
        '"vendor_reference_id": "v1", "refund_reason": "  "}\n'
    )
    for provider, region, path in (
        ("apple", "AMER", apple), ("google", "EMEA", google), ("roku", "AMER", roku),
        ("direct_billing", "AMER", str(billing)),
    ):
        result = load_file(tables, FileLoad(provider, region, path, f"f_{provider}", as_of=AS_OF))
        assert (result.status, result.staged_rows) == ("LOADED_FACT", 1)
    fact = {r.pmt_channel: r for r in tables.read("payments").collect()}
    assert set(fact) == {"Google", "Roku", "DirectBilling"}
    assert str(fact["DirectBilling"].main_amount) == "1.500000"
    assert fact["Roku"].record_key == "r1~2024-01-05 10:00:00~Purchase~"
    assert tables.read("raw_google_emea").count() == 1
    assert tables.read("raw_google").count() == 0
    typed = tables.read("typed_direct_billing").collect()[0]
    assert typed.installment_details_number_of_installments == 3
    assert (typed.items_item_id, typed.refund_reason, typed.realm) == (
        "it1", None, "direct_billing",
    )
    sold = tables.read("apple_sales").collect()[0]
    assert (sold.begin_date, sold.end_date) == (date(2024, 1, 5), date(2024, 1, 6))
    known = {(r.payment_provider, r.sku_id) for r in tables.skus().collect()}
    assert known == {("Apple", "a.annual"), ("Google", "g.month"), ("Roku", "r.plan")}


def test_the_monitor_follows_a_load(tables, spark, tmp_path):
    config = spark.createDataFrame(
        [("m", "ENABLED", "Amazon", "SALES", 6, None, None, None, None, None)], ddl(MONITOR_CONFIG)
    )
    tables.append("monitor_config_log", config)
    collected = [
        (f"d{day}", "Amazon_GO", "SALES", f"amazon_go_sales_2024-01-{day:02d}.csv",
         datetime(2024, 1, day), day)
        for day in (5, 15, 20)
    ]
    tables.append("collection_audit", spark.createDataFrame(collected, ddl(COLLECTION_AUDIT)))
    for day in (5, 15):
        path = amazon_file(tmp_path, day, [amazon_row(n) for n in range(day)])
        load_file(tables, amazon_load(path, f"d{day}", monitor_id="m"))
    master = {r.file_tx_id: r for r in tables.read("ingestion_master").collect()}
    first, second, third = master["d5"], master["d15"], master["d20"]
    assert (first.load_status, first.raw_transaction_count, first.fact_transaction_count) == (
        "SUPERSEDED", 5, 0,
    )
    assert (first.overwritten, first.pct_fact, first.variance) == (5, 0.0, 100.0)
    assert (second.load_status, second.overwritten, second.variance) == ("LOADED_FACT", 0, 100.0)
    assert (third.load_status, third.raw_file_count, third.variance) == (None, 0, 0.0)
    stamped = tables.monitor_config().collect()
    assert len(stamped) == 1
    assert (stamped[0].mv_row_count, stamped[0].mv_min_date) == (3, date(2024, 1, 5))
    assert stamped[0].mv_updated_timestamp is not None
    again = monitor_of(tables, "m", "amazon", AS_OF)
    assert again.count() == 3
    other = spark.createDataFrame([("d5",), ("d5",), ("d15",), ("x",)], "file_tx_id string")
    given = monitor_of(tables, "m", "none", AS_OF, Layers([other, other], other, other))
    raw = {r.file_tx_id: r.raw_transaction_count for r in given.collect()}
    assert raw == {"d5": 4, "d15": 2, "d20": 0}


def test_accrual_is_stored_per_day(tables, spark, tmp_path):
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, [amazon_row(1)]), "d5"))
    lookups = AccrualLookups(
        spark.createDataFrame([("USD", "US")], "currency_code string, country_code string"),
        tables.skus(),
        spark.createDataFrame(
            [("USD", date(2024, 1, 5), 1.0)],
            "currency_code string, exchange_rate_date date, exchange_rate double",
        ),
        spark.createDataFrame([("us", 0.0)], "country_code string, vat_rate double"),
        spark.createDataFrame(
            [("StreamCo", "Amazon", "All", 0.2)],
            "company string, provider string, area string, commission_rate double",
        ),
    )
    path = str(tmp_path / "accrual")
    for _ in range(2):
        refresh_accrual(tables, lookups, AS_OF, path)
    stored = spark.read.parquet(path).collect()
    assert len(stored) == 1
    assert str(stored[0].daily_revenue_rate) == "0.027295"
    assert stored[0].mv_last_updated is not None


def files_seen(tables):
    """What readers see: by the method and by the view."""
    by_view = tables.spark.table(tables.name("payments")).select("file_tx_id").distinct().collect()
    by_method = tables.payments().select("file_tx_id").distinct().collect()
    assert sorted(by_view) == sorted(by_method)
    return sorted(r.file_tx_id for r in by_view)


def test_readers_see_a_file_or_those_it_replaces(tables, spark, tmp_path):
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, [amazon_row(1)]), "d5"))
    rows = spark.createDataFrame(tables.payments().collect(), ddl(PAYMENTS))
    newer = rows.withColumn("file_tx_id", F.lit("d6"))
    staged = tables.stage("Amazon", "d6", newer, sku_revenue(store_sales(newer)))
    assert files_seen(tables) == ["d5"]  # a reader, or a load that died, between the two steps
    gone = spark.createDataFrame([("Amazon", "d5")], "pmt_channel string, file_tx_id string")
    tables.publish(staged, gone)
    assert files_seen(tables) == ["d6"]
    assert [r.file_tx_id for r in tables.sku_sales().collect()] == ["d6"]


def test_vacuum_drops_what_is_not_in_force(tables, spark, tmp_path):
    for day in (5, 6):
        load_file(tables, amazon_load(amazon_file(tmp_path, day, [amazon_row(1)]), f"d{day}"))
    rows = spark.createDataFrame(tables.payments().collect(), ddl(PAYMENTS))
    tables.stage("Amazon", "died", rows, sku_revenue(store_sales(rows)))
    raw = spark.table(tables.name("payments_store"))
    assert raw.count() == 3
    assert tables.vacuum(before=0) == 0
    assert tables.vacuum(before=time.time_ns()) == 4  # payments and sums of d5 and of the load that died
    assert spark.table(tables.name("payments_store")).count() == 1
    assert files_seen(tables) == ["d6"] and tables.sku_sales().count() == 1


def files_opened(df):
    """How many data files the scan of the payments opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    opened = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if ("generation" in leaf.toString() or "stored" in leaf.toString()) and "record_key" in leaf.toString():
            opened += leaf.metrics().apply("numFiles").value()
    return opened


def test_only_files_with_days_in_the_window_are_opened(tables, spark, tmp_path):
    for month in range(1, 7):
        row = {**amazon_row(month), "transaction_time": f"2024-{month:02d}-10 12:00:00 UTC"}
        path = write_file(tmp_path, f"amazon_go_sales_2024-{month:02d}-28.csv", "amazon", [row])
        load_file(tables, amazon_load(path, f"m{month}"))
    days = {r.file_tx_id: (r.first_day, r.last_day, r.file_rows) for r in tables.file_sets().collect()}
    assert days["m3"] == (date(2024, 3, 10), date(2024, 3, 10), 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plan hides the scans
    try:
        assert files_opened(tables.payments().select("record_key", "file_tx_id")) == 6
        some = tables.payments(date(2024, 3, 1), date(2024, 4, 30))
        assert {r.file_tx_id for r in some.collect()} == {"m3", "m4"}
        assert files_opened(some.select("record_key", "file_tx_id")) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_closed_month_reads_as_before_from_few_files(tables, spark, tmp_path):
    """Six files of two months; one is replaced after the closing, one comes again."""
    for n in range(1, 7):
        month = 1 if n < 6 else 2
        rows = [{**amazon_row(10 * n + k), "transaction_time": f"2024-{month:02d}-{n:02d} 12:0{k}:00 UTC"} for k in range(3)]
        path = write_file(tmp_path, f"amazon_r{n}_sales_2024-{month:02d}-{n:02d}.csv", "amazon", rows)
        load_file(tables, amazon_load(path, f"f{n}"))

    def answers():
        rows = sorted(map(str, tables.payments().collect()))
        viewed = sorted(map(str, spark.table(tables.name("payments")).select(*PAYMENTS).collect()))
        assert rows == viewed
        return rows, sorted(map(str, tables.sku_sales().collect())), files_seen(tables)

    before = answers()
    assert tables.close_month(date(2023, 1, 1)) == 0
    assert tables.close_month(date(2024, 1, 31), files=2) == 5 and answers() == before
    assert tables.close_month(date(2024, 1, 1)) == 0
    assert tables.vacuum(before=time.time_ns()) == 5 and answers() == before
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = tables.payments(date(2024, 1, 1), date(2024, 1, 31)).select("record_key", "file_tx_id")
        assert one.count() == 15 and files_opened(one) <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    single = tables.read_file("payments", "f3")
    assert single.count() == 3
    assert "EqualTo(file_tx_id,f3)" in single._jdf.queryExecution().executedPlan().toString()

    late = write_file(tmp_path, "amazon_r2_sales_2024-01-09.csv", "amazon", [amazon_row(99)])
    load_file(tables, amazon_load(late, "f2b"))
    assert files_seen(tables) == ["f1", "f2b", "f3", "f4", "f5", "f6"]
    assert tables.payments().count() == 16
    assert tables.close_month(date(2024, 1, 1)) == 1 and tables.payments().count() == 16


def test_a_closing_that_dies_changes_nothing(tables, tmp_path, monkeypatch):
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, [amazon_row(1), amazon_row(2)]), "d5"))
    before = sorted(map(str, tables.payments().collect()))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "append", die)
        with pytest.raises(RuntimeError, match="lost"):
            tables.close_month(date(2024, 1, 1))
    assert sorted(map(str, tables.payments().collect())) == before
    assert tables.vacuum(before=time.time_ns()) == 1  # the copy that nobody reads
    assert tables.close_month(date(2024, 1, 1)) == 1
    assert sorted(map(str, tables.payments().collect())) == before


def sku_flags(tables):
    return sorted((r.sku_id, r.included_in_accrual_yn) for r in tables.skus().collect())


def test_the_ledger_follows_reloads_and_supersession(tables, spark, tmp_path):
    free, paid = amazon_row(1, sku="a.month", price="0"), amazon_row(2, sku="a.month", price="4")
    other = amazon_row(3, sku="b.month", price="0")
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, [free, other]), "d5"))
    assert sku_flags(tables) == [("a.month", "N"), ("b.month", "N")]
    load_file(tables, amazon_load(amazon_file(tmp_path, 6, [paid, other]), "d6"))
    assert sku_flags(tables) == [("a.month", "Y"), ("b.month", "N")]
    sums = {(r.file_tx_id, r.sku_id): str(r.value) for r in tables.sku_sales().collect()}
    assert sums == {("d6", "a.month"): "4.000000", ("d6", "b.month"): "0.000000"}
    before = sku_flags(tables)
    refresh_skus(tables)
    assert sku_flags(tables) == before
    # the file comes again with other rows: its sums are replaced, not added
    tables.append("load_audit_log", tables.audit().where("file_tx_id = 'd6'").withColumns({
        "status": F.lit("LOAD_ERROR"), "load_date_time": F.localtimestamp()}))
    load_file(tables, amazon_load(amazon_file(tmp_path, 6, [{**other, "sales_price_marketplace_currency": "3"}]), "d6"))
    assert {(r.file_tx_id, r.sku_id, str(r.value)) for r in tables.sku_sales().collect()} == {("d6", "b.month", "3.000000")}
    assert sku_flags(tables) == [("a.month", "Y"), ("b.month", "Y")]


def test_apple_returns_count_in_the_ledger(tables, tmp_path):
    def load(file_id, units):
        row = {"sku": "a.month", "units": units, "customer_price": "2", "begin_date": "1/5/2024",
               "end_date": "1/6/2024", "subscription": "New"}
        path = write_file(tmp_path, f"{file_id}.txt", "apple", [row], sep="\t")
        load_file(tables, FileLoad("apple", "AMER", path, file_id, as_of=AS_OF))

    load("f1", 0)
    load("f2", -3)
    load("f3", 2)
    assert sku_flags(tables) == [("a.month", "N")]
    load("f4", 2)
    assert sku_flags(tables) == [("a.month", "Y")]


def log_files(tables, log):
    rows = tables.read(log).select(F.input_file_name().alias("f")).distinct()
    return rows.count()


def test_compaction_keeps_every_answer(tables, spark, tmp_path, monkeypatch):
    for day in range(6, 9):
        load_file(tables, amazon_load(amazon_file(tmp_path, day, [amazon_row(day)]), f"d{day}"))

    def answers():
        return [sorted(map(str, x.collect())) for x in (tables.audit(), tables.skus(), tables.file_sets(), tables.payments())]

    before = answers()
    assert log_files(tables, "load_audit_log") > 8
    for log in LOGS:
        tables.compact(log)
        assert answers() == before and log_files(tables, log) <= 1
    load_file(tables, amazon_load(amazon_file(tmp_path, 9, [amazon_row(9)]), "d9"))
    assert files_seen(tables) == ["d9"] and statuses(tables)["d8"] == "SUPERSEDED"
    before = answers()

    class Died(Exception):
        pass

    real, turns = RevenueTables._turn, []

    def die_at_the_switch(self, log, read_from, write_epoch):
        turns.append(read_from)
        if len(turns) == 2:
            raise Died
        real(self, log, read_from, write_epoch)

    monkeypatch.setattr(RevenueTables, "_turn", die_at_the_switch)
    with pytest.raises(Died):
        tables.compact("load_audit_log")
    monkeypatch.undo()
    assert answers() == before
    load_file(tables, amazon_load(amazon_file(tmp_path, 10, [amazon_row(10)]), "d10"))
    before = answers()
    for _ in range(2):
        tables.compact("load_audit_log")
        assert answers() == before and log_files(tables, "load_audit_log") == 1
    assert spark.sql(f"SHOW PARTITIONS {tables.name('load_audit_log')}").count() == 2


def test_a_sku_that_was_only_refunded_before_is_promoted_by_its_history(tables, tmp_path):
    refund = [amazon_row(1, sku="go.month", price="-5", kind="Refund")]
    path = write_file(tmp_path, "amazon_go_sales_2023-12-31.csv", "amazon", refund)
    load_file(tables, amazon_load(path, "dec"))
    assert tables.skus().count() == 0
    free = [amazon_row(2, sku="go.month", price="0")]
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, free), "jan"))
    assert [(r.sku_id, r.included_in_accrual_yn) for r in tables.skus().collect()] == [
        ("go.month", "Y")
    ]


def test_refreshing_skus_finds_what_single_loads_missed(tables, spark, tmp_path):
    load_file(tables, amazon_load(amazon_file(tmp_path, 5, [amazon_row(1)]), "d5"))
    rows = tables.read("payments").collect()
    extra = spark.createDataFrame(rows, ddl(PAYMENTS)).withColumn("vendor_sku", F.lit("late.year"))
    store(tables, extra.withColumn("file_tx_id", F.lit("d6")), "d6")
    refresh_skus(tables)
    refresh_skus(tables)
    assert sorted(r.sku_id for r in tables.skus().collect()) == ["go.plan.annual", "late.year"]


def test_written_files_and_large_closed_months_are_spread_over_tasks(tables, spark, tmp_path, monkeypatch):
    rows = [{**amazon_row(n), "transaction_time": f"2024-01-05 12:00:{n:02d} UTC"} for n in range(12)]
    sent = spark.createDataFrame(
        [tuple(str(r.get(c, "")) for c in raw_widths("amazon")) for r in rows], ddl(dict.fromkeys(raw_widths("amazon"), "string"))
    )
    path = _written(tables, sent.repartition(4), "amazon", "amazon_go_sales_2024-01-05.csv")
    assert len(spark.read.text(path).inputFiles()) == 4
    assert load_file(tables, amazon_load(path, "f1")).staged_rows == 12
    before = sorted(map(str, tables.payments().collect()))
    monkeypatch.setattr("tillroll.sources.tables.CLOSED_FILES", 1)
    monkeypatch.setattr("tillroll.sources.tables.CLOSED_FILE_ROWS", 4)
    assert tables.close_month(date(2024, 1, 1)) == 1
    assert len(spark.table(tables.name("payments_closed")).inputFiles()) == 3
    assert sorted(map(str, tables.payments().collect())) == before
