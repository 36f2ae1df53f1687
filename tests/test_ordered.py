"""Ordered work cell by cell against the same work done by hand, with one hot key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators.lookups import unique_lookup
from tillroll.operators.ordered import (
    exact_quantiles,
    hour_bucket,
    latest,
    position,
    previous,
    running_total,
)

START = datetime(2024, 1, 1)


def events(seed, n=600):
    """A third of the rows under one key, repeated times, some without a time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(60)}"
        at = None if rng.random() < 0.03 else START + timedelta(minutes=rng.randrange(3000))
        rows.append((i, key, at, rng.randrange(-5, 20)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, at timestamp_ntz, v int").repartition(3)


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_position(spark, seed):
    rows = events(seed)
    got = position(frame(spark, rows), ["key"], ["at", "id"], hour_bucket(F.col("at")), "nr")
    want = {r[0]: n for group in by_key(rows).values() for n, r in enumerate(group, 1)}
    assert {r.id: r.nr for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_running_total(spark, seed):
    rows = events(seed)
    got = running_total(
        frame(spark, rows), ["key"], ["at", "id"], F.col("v"), hour_bucket(F.col("at")), "sum"
    )
    want = {}
    for group in by_key(rows).values():
        total = 0
        for r in group:
            total += r[3]
            want[r[0]] = total
    assert {r.id: r["sum"] for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_previous(spark, seed):
    rows = [r if r[3] > 0 else (*r[:3], None) for r in events(seed)]
    got = previous(
        frame(spark, rows), ["key"], ["at", "id"], hour_bucket(F.col("at")),
        {"v": "before", "id": "before_id"},
    )
    want = {}
    for group in by_key(rows).values():
        for n, r in enumerate(group):
            want[r[0]] = (group[n - 1][3], group[n - 1][0]) if n else (None, None)
    assert {r.id: (r.before, r.before_id) for r in got.collect()} == want


def test_latest(spark):
    rows = events(4)
    got = latest(frame(spark, rows), ["key"], [F.col("at").desc(), F.col("id").desc()])
    assert {r.id for r in got.collect()} == {group[-1][0] for group in by_key(rows).values()}


def test_latest_prunes_before_the_shuffle(spark):
    df = latest(frame(spark, events(5)), ["key"], [F.col("at").desc()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_hot_key_is_cut_into_cells(spark):
    """The window's shuffle is by key and cell, so a hot key's rows go to many tasks."""
    df = position(frame(spark, events(6)), ["key"], ["at", "id"], hour_bucket(F.col("at")), "nr")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line and "id" in line]
    assert rows and all("_bucket" in line for line in rows)


def test_a_hot_key_is_spread_over_tasks(spark):
    """No task gets most of a key that holds a third of all rows."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        df = position(frame(spark, events(7, 3000)), ["key"], ["at", "id"],
                      hour_bucket(F.col("at")), "nr")
        sizes = (
            df.where(F.col("key") == "hot").groupBy(F.spark_partition_id()).count().collect()
        )
    finally:
        spark.conf.set(setting, old)
    assert len(sizes) > 1
    assert max(r["count"] for r in sizes) < 0.6 * sum(r["count"] for r in sizes)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles(spark, seed):
    rows = events(seed)
    names = {"low": 0.05, "mid": 0.5, "high": 0.93, "first": 0.0, "last": 1.0}
    got = exact_quantiles(
        frame(spark, rows), ["key"], "v", names, F.floor(F.col("v") / 4)
    ).collect()
    groups = by_key(rows)
    assert len(got) == len(groups)
    for row in got:
        values = [r[3] for r in groups[row.key]]
        assert row.rows == len(values)
        for name, p in names.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_unique_lookup_passes_and_raises(spark):
    once = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, unique_lookup(once, ["k"], "t").collect())) == [("a", 1), ("b", 2)]
    twice = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="t repeats the key: a"):
        unique_lookup(twice, ["k"], "t").collect()
