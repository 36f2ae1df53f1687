"""Ordered work per key that does not put a whole key into one task.

A plain window sends every row of a key to one task, which fails to scale when one key holds a
large share of the data. Here the key is cut into cells by a `bucket` that rises with the order
(an hour, a day): the window runs per cell, a small table of one row per cell carries the running
state from cell to cell, and the two are joined on the cell. The answers equal the plain window's.

Key columns must not be NULL; callers set such rows aside first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_bucket(ts: Column) -> Column:
    """Hours since 1970 of a zone-less timestamp."""
    return F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)


def _cell(bucket: Column) -> Column:
    """The bucket as a number; a missing one comes before all others, as NULLs do in the order."""
    return F.coalesce(bucket.cast("bigint"), F.lit(-(2**62)))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by `order`. Spark keeps one candidate per key in every map task
    (WindowGroupLimit), so a hot key shrinks before the shuffle."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    bucket: Column,
    out: str,
) -> DataFrame:
    """Sum of `weight` over the key's rows up to and including this one, in `order`."""
    cell = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", _cell(bucket)).withColumn("_weight", weight)
    within = Window.partitionBy(*cell).orderBy(*order)
    local = rows.withColumn(
        "_local", F.sum("_weight").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    earlier_cells = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        rows.groupBy(*cell)
        .agg(F.sum("_weight").alias("_cell"))
        .withColumn("_before", F.sum("_cell").over(earlier_cells))
        .where(F.col("_before").isNotNull())
        .select(*cell, "_before")
    )
    total = F.col("_local") + F.coalesce("_before", F.lit(0))
    return (
        local.join(before, cell, "left")
        .withColumn(out, total)
        .select(*df.columns, out)
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "position"
) -> DataFrame:
    """1, 2, 3, ... within the key, in `order`."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), bucket, out)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: dict[str, str],
) -> DataFrame:
    """Add, for each `column: name`, the column's value in the key's row before this one."""
    cell = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", _cell(bucket))
    state = F.struct(*[F.col(c).alias(name) for c, name in columns.items()])
    within = Window.partitionBy(*cell).orderBy(*order)
    local = rows.withColumn("_local", F.lag(state).over(within))
    last_of_cell = latest(
        rows.select(*cell, *{c: None for c in [*order, *columns] if c not in cell}),
        cell,
        [F.col(c).desc() for c in order],
    )
    carried = (
        last_of_cell.withColumn(
            "_carried", F.lag(state).over(Window.partitionBy(*keys).orderBy("_bucket"))
        )
        .where(F.col("_carried").isNotNull())
        .select(*cell, "_carried")
    )
    found = F.coalesce("_local", "_carried")
    return local.join(carried, cell, "left").select(
        *df.columns, *[found[name].alias(name) for name in columns.values()]
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], bucket: Column
) -> DataFrame:
    """Exact interpolated quantiles of `value` per key, one column per name in `probabilities`.

    Equal values are counted first, so what is ordered is the distinct values only, and these are
    ranked cell by cell; no task holds all values of a key. Keys must not be NULL.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_total(counts, keys, [value], F.col("_n"), bucket, "_upto")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    rows = ranked.join(sizes, list(keys))
    picks = [F.max("_size").alias("rows")]
    for name, p in probabilities.items():
        rank = (F.col("_size") - 1) * F.lit(float(p))
        for side, wanted in (("lo", F.floor(rank) + 1), ("hi", F.ceil(rank) + 1)):
            here = (F.col("_upto") - F.col("_n") < wanted) & (wanted <= F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    picked = rows.groupBy(*keys).agg(*picks)
    out = []
    for name, p in probabilities.items():
        rank = (F.col("rows") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return picked.select(*keys, "rows", *out)
