"""One-to-one matching of two sides whose days may differ by a few.

Every row of a side may answer one row of the other side with the same key whose day is at most `days` away.
All windows are equally wide, so serving the row whose window closes first is best: no other matching has
more pairs. Rows of one key and day are alike to it, so it runs on their counts: a fold over the days of a
key that carries what is still open. A side's open rows are the queue; both sides are never open at
once, as they would answer each other. What the fold says per day, how many rows are answered, turns into
pairs by numbers: the n-th answered row of one side goes with the n-th of the other.

A key's rows are counted before they are shuffled and numbered in cells of an hour, so a key of any number
of rows is spread over many tasks; the fold sees a pair of numbers per day of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.ordered import hour_bucket, position

_OPEN = "array<struct<day:int,left:bigint,n:bigint>>"
_DONE = "array<struct<day:int,left:bigint,right:bigint>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _sum(items: Column, name: str) -> Column:
    return F.aggregate(items, _long(0), lambda total, x: total + x[name])


def answered_days(cells: Column, days: int) -> Column:
    """Of day cells (day int, left, right: rows of each side), ascending: (day, left, right), how many rows
    of each side are answered. A day may come several times; its numbers add up.

    The queue holds (day, left, n): left is 1 if it is the left side that is open and 0 otherwise.
    """

    def step(state: Column, cell: Column) -> Column:
        def of_open(queue: Column) -> Column:
            return _let(F.coalesce(F.get(queue, F.lit(0))["left"], _long(0)), lambda side: _let(_taken(queue, side), lambda taken: carried(queue, side, taken)))

        def _taken(queue: Column, side: Column) -> Column:
            here = F.when(F.size(queue) == 0, _long(0)).when(side == 1, cell["right"]).otherwise(cell["left"])
            return F.least(here, _sum(queue, "n"))

        def carried(queue: Column, side: Column, taken: Column) -> Column:
            left = cell["left"] - F.when(side == 0, taken).otherwise(_long(0))
            right = cell["right"] - F.when(side == 1, taken).otherwise(_long(0))

            def served(x: Column, i: Column) -> Column:
                before = _sum(F.slice(queue, F.lit(1), i), "n")
                now = F.greatest(_long(0), F.least(x["n"], taken - before))
                return F.struct(x["day"].alias("day"), x["left"].alias("left"), x["n"].alias("n"), now.alias("now"))

            def after(queue_now: Column) -> Column:
                both = F.least(left, right)
                rest = F.array(
                    F.struct(cell["day"].alias("day"), _long(1).alias("left"), (left - both).alias("n")),
                    F.struct(cell["day"].alias("day"), _long(0).alias("left"), (right - both).alias("n")),
                )
                still = F.transform(queue_now, lambda x: F.struct(x["day"].alias("day"), x["left"].alias("left"), (x["n"] - x["now"]).alias("n")))
                done = F.transform(
                    F.filter(queue_now, lambda x: x["now"] > 0),
                    lambda x: F.struct(x["day"].alias("day"), (x["now"] * x["left"]).alias("left"), (x["now"] * (1 - x["left"])).alias("right")),
                )
                own = F.struct(
                    cell["day"].alias("day"),
                    (both + F.when(side == 0, taken).otherwise(_long(0))).alias("left"),
                    (both + F.when(side == 1, taken).otherwise(_long(0))).alias("right"),
                )
                return F.struct(
                    F.filter(F.concat(still, rest), lambda x: x["n"] > 0).cast(_OPEN).alias("queue"),
                    F.concat(state["done"], done.cast(_DONE), F.array(own).cast(_DONE)).alias("done"),
                )

            return _let(F.transform(queue, served), after)

        return _let(F.filter(state["queue"], lambda x: x["day"] >= cell["day"] - days), of_open)

    start = F.struct(F.array().cast(_OPEN).alias("queue"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(cells, start, step, lambda state: state["done"])


def pair_within_days(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ident: str, days: int) -> DataFrame:
    """All rows of both sides, those that answer each other side by side and the others alone.

    Both sides have the keys, a zone-less time `at` and a unique `ident`; their other columns differ and come
    back with {ident}_left and {ident}_right. A row with a NULL key or time is alone. Of a day's rows, the
    first by time, then ident, are answered. Each side is read twice: to count its rows and to number them.
    """
    own_keys = [*keys, "_own"]
    cell = [*own_keys, "_day"]
    sides = {}
    for name, df in (("left", left), ("right", right)):
        whole = F.col(at).isNotNull()
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        alone = F.concat(F.lit(f"{name} "), F.col(ident).cast("string"))
        sides[name] = df.withColumn("_own", F.when(whole, F.lit("")).otherwise(alone)).withColumns(
            {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}
            | {"_day": F.coalesce(F.unix_date(F.col(at).cast("date")), F.lit(0))}
        )
    counts = (
        sides["left"].select(*cell, _long(1).alias("l"), _long(0).alias("r"))
        .unionByName(sides["right"].select(*cell, _long(0).alias("l"), _long(1).alias("r")))
        .where(F.col("_own") == "")
        .groupBy(*cell)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    days_of_key = F.struct(F.col("_day").alias("day"), F.col("l").alias("left"), F.col("r").alias("right"))
    listed = counts.groupBy(*own_keys).agg(
        F.sort_array(F.collect_list(days_of_key)).alias("_cells"), F.sum("l").alias("_l"), F.sum("r").alias("_r")
    )
    both = listed.where((F.col("_l") > 0) & (F.col("_r") > 0))
    answered = (
        both.select(*own_keys, F.explode(answered_days(F.col("_cells"), days)).alias("_x"))
        .groupBy(*own_keys, F.col("_x.day").alias("_day"))
        .agg(F.sum("_x.left").alias("left"), F.sum("_x.right").alias("right"))
    )
    earlier = Window.partitionBy(*own_keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    found = {}
    for name, df in sides.items():
        before = F.coalesce(F.sum(name).over(earlier), F.lit(0))
        served = answered.withColumn("_before", before).where(F.col(name) > 0).select(*cell, F.col(name).alias("_n"), "_before")
        numbered = position(df, cell, [at, ident], hour_bucket(F.col(at)), "_rank").join(served, cell, "left")
        number = F.when(F.col("_rank") <= F.col("_n"), F.col("_before") + F.col("_rank"))
        alone = F.concat(F.lit(f"{name} "), F.col(ident).cast("string"))
        found[name] = (
            numbered.withColumn("_nr", F.coalesce(number, F.lit(0)))
            .withColumn("_own", F.when(F.col("_nr") > 0, F.lit("")).otherwise(alone))
            .drop("_day", "_rank", "_n", "_before", at)
            .withColumnRenamed(ident, f"{ident}_{name}")
        )
    return found["left"].join(found["right"], [*own_keys, "_nr"], "full").drop(*own_keys, "_nr")
