"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's target is its share of the largest mix for which no source lacks a row; its rows are dealt in
blocks, one block a slot. With N blocks in all, block j of the B of a source is released at slot
floor(j * N / B) and due at ceil((j + 1) * N / B); each slot takes the released block that is due first, and
all meet their due times. So after T slots a source has T * B / N blocks, rounded down or up: at every slot
it is less than one block away from its exact share, and at the end all have exactly their target.

The schedule is one for all slots, but it is computed in cycles that do not wait for each other. Before any
cycle a source has had either all its released blocks or all but the last one, and which sources still have
one waiting follows from the release and due times alone (_waiting). Numbers of blocks are multiplied as
longs: 3 billion blocks at most; take larger blocks for more rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.scratch import stored

CYCLE = 2048
BLOCK_ROWS = 4
CELL_ROWS = 1000
RUN = 4096  # blocks or cycles that one row is exploded into
MOST_DIGITS = 4  # cells of the hashed order: 16 to this power at most
LARGEST_SHARE = 4  # by default no source weighs more than 1/4 of all rows


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _up(a: Column, b: Column | int) -> Column:
    return -_div(-a, b) + (a % b > 0).cast("long")  # div drops the fraction


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _weighed(counts: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    if weights is None:
        everything = Window.partitionBy()  # a row per source
        return counts.withColumn("w", F.least("n", F.greatest(F.lit(1), F.floor(F.sum("n").over(everything) / LARGEST_SHARE))))
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,long>")
    return counts.withColumn("w", given[F.col("name")].cast("long")).where("w > 0")


def source_slots(counts: DataFrame, weights: dict[str, int] | None = None, cycle: int = CYCLE) -> DataFrame:
    """name, n, p: the slots of each source in a cycle, by largest remainder; a rare one may have none.

    counts: name, n per source. Without weights a source weighs its rows, but no more than a quarter of
    all rows. Sources that `weights` does not name, or names with 0, are left out.
    """
    everything = Window.partitionBy()  # a row per source
    total = F.sum("w").over(everything)
    shared = _weighed(counts, weights).select("name", "n", _div(F.col("w") * cycle, total).alias("p"), (F.col("w") * cycle % total).alias("rest"))
    left = F.lit(cycle) - F.sum("p").over(everything)
    order = Window.orderBy(F.desc("rest"), "name")
    return shared.select("name", "n", (F.col("p") + (F.row_number().over(order) <= left).cast("long")).alias("p"))


def source_targets(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """name, n, target: the rows of each source in the largest mix of these weights that no source is too
    small for, rounded down. Weights as in source_slots: without any, a source of up to a quarter of all
    rows has all its rows as target, however small it is.
    """
    weighed = _weighed(counts, weights)
    scarce = F.min_by(F.struct("n", "w"), F.col("n") / F.col("w")).over(Window.partitionBy())
    wide = "decimal(19,0)"
    target = _div(F.col("w").cast(wide) * F.col("scarce.n").cast(wide), F.col("scarce.w").cast(wide))
    return weighed.withColumn("scarce", scarce).select("name", "n", F.least("n", target).alias("target"))


def block_windows(blocks: DataFrame) -> DataFrame:
    """name, block, total, released, due: the window of each block, from the exact weight of its source.

    blocks: name, b (the number of its blocks) per source. A source is dealt out in runs of RUN blocks, so
    one with most of all blocks is spread over the tasks.
    """
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = F.sum("b").over(Window.partitionBy())  # a row per source
    sources = blocks.where("b > 0").select("name", F.col("b").cast("long").alias("b")).withColumn("total", total)
    runs = sources.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1, F.lit(RUN).cast("long"))))
    last = F.least(F.col("run") + RUN, "b") - 1
    each = runs.repartition(tasks, "name", "run").withColumn("block", F.explode(F.sequence(F.col("run"), last)))
    return each.select("name", "block", "total", _released(F.col("block"), F.col("b"), F.col("total")).alias("released"), _due(F.col("block"), F.col("b"), F.col("total")).alias("due"))


def _released(block: Column, b: Column, total: Column) -> Column:
    return _div(block * total, b)


def _due(block: Column, b: Column, total: Column) -> Column:
    return _up((block + 1) * total, b)


def _cycles(blocks: DataFrame, cycle: int) -> DataFrame:
    """m, begin, end, total, s (name, b), waiting: the blocks released and not yet dealt at `end`, a number."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = (
        blocks.where("b > 0")
        .agg(F.sort_array(F.collect_list(F.struct("name", F.col("b").cast("long").alias("b")))).alias("s"), F.sum("b").cast("long").alias("total"))
        .where("total > 0")
    )
    count = _up(F.col("total"), cycle)
    runs = one.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), count - 1, F.lit(RUN).cast("long"))))
    each = runs.repartition(tasks, "run").withColumn("m", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, count) - 1)))
    ends = each.withColumn("begin", F.col("m") * cycle).withColumn("end", F.least((F.col("m") + 1) * cycle, "total"))
    released = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + _up(F.col("end") * x["b"], F.col("total")))
    return ends.select("m", "begin", "end", "total", "s", (released - F.col("end")).alias("waiting"))


def _waiting(blocks: DataFrame, cycles: DataFrame, cycle: int) -> DataFrame:
    """m, waiting: the sources with a block that waits at the end of cycle m, released and due behind it.

    Earliest due first never idles, so the number of blocks that wait at a slot is that of the released
    ones less that of the slots. Of the blocks released before slot a, no more can still wait at the end
    of the cycle than at any slot from a on: `room` is the least of these numbers. Within these bounds,
    the blocks that wait are the ones that are due last.
    """
    windows = block_windows(blocks).withColumn("m", _div(F.col("released"), cycle))
    at_end = cycles.select("m", F.col("waiting").alias("at_end"))
    before = cycles.select((F.col("m") + 1).alias("m"), F.col("waiting").alias("at_begin"))
    known = windows.join(at_end, "m").join(before, "m", "left").withColumn("back", -F.col("released"))
    earlier = Window.partitionBy("m").orderBy("released").rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("m").orderBy("back").rangeBetween(Window.unboundedPreceding, -1)
    number = F.coalesce("at_begin", F.lit(0)) + F.count("*").over(earlier) - (F.col("released") - F.col("m") * cycle)
    low = known.withColumn("here", number).withColumn("room", F.least("at_end", F.min("here").over(later)))
    low = stored(low.select("m", "name", "block", "released", "due", "here", "room"), "mix-windows")

    inside = low.where(F.col("released") > F.col("m") * cycle).groupBy("m").agg(F.min("here").alias("here"))
    whole = at_end.join(inside, "m", "left").select(F.col("m").alias("at"), F.least("at_end", "here").alias("least"))
    over = low.withColumn("last", _div(F.col("due") - 1, cycle) - 1).where("last >= m")
    each = over.withColumn("at", F.explode(F.sequence("m", "last"))).join(whole, "at")
    so_far = Window.partitionBy("name", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    room = F.min(F.when(F.col("at") == F.col("m"), F.col("room")).otherwise(F.col("least"))).over(so_far)
    per_cycle = each.withColumn("room", room.cast("int")).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("released", "due", "name", "room"))).alias("open"))

    def kept(held: Column, x: Column) -> Column:
        return F.slice(F.sort_array(F.concat(held, F.array(F.struct(x["due"].alias("due"), x["name"].alias("name")))), asc=False), 1, x["room"])

    none = F.array().cast("array<struct<due:bigint,name:string>>")
    return per_cycle.select(F.col("at").alias("m"), F.aggregate("open", none, kept, lambda x: x["name"]).alias("waiting"))


def cycle_states(blocks: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """begin, length, total, s (name, b, done): the state of the global schedule before each cycle.

    blocks: name, b per source. `done` is the number of blocks that the source has had before `begin`;
    sources without a block to deal in the cycle are left out. No cycle waits for another: each state
    follows from the windows of the blocks (see _waiting).
    """
    cycles = stored(_cycles(blocks, cycle), "mix-ends")
    late = _waiting(blocks, cycles, cycle).select((F.col("m") + 1).alias("m"), F.col("waiting").alias("late"))

    def state(x: Column) -> Column:
        waits = F.coalesce(F.array_contains("late", x["name"]).cast("long"), F.lit(0).cast("long"))
        return F.struct(x["name"].alias("name"), x["b"].alias("b"), (_up(F.col("begin") * x["b"], F.col("total")) - waits).alias("done"))

    states = F.filter(F.transform("s", state), lambda x: _up(F.col("end") * x["b"], F.col("total")) > x["done"])
    return cycles.join(late, "m", "left").select("begin", (F.col("end") - F.col("begin")).alias("length"), "total", states.alias("s"))


def cycle_schedule(states: DataFrame) -> DataFrame:
    """name, block, begin, slot, released, due: the blocks of the cycles of cycle_states.

    Earliest due first, one slot after the other; ties go to the first name.
    """
    total = F.col("total")

    def turn(i: Column, block: Column) -> Column:
        def of(b: Column) -> Column:
            fields = (_due(block, b, total).alias("due"), i.alias("i"), _released(block, b, total).alias("released"), block.alias("block"))
            return F.when(block < b, F.struct(*fields))

        return _let(F.get(F.col("s"), i)["b"], of)

    def run(state: Column, t: Column) -> Column:
        ready = F.filter(state["next"], lambda x: x["released"] <= F.col("begin") + t)
        return _let(
            F.array_min(ready),
            lambda first: F.struct(
                F.transform(state["next"], lambda x: F.when(x["i"] == first["i"], turn(x["i"], x["block"] + 1)).otherwise(x)).alias("next"),
                F.concat(state["taken"], F.array(first)).alias("taken"),
            ),
        )

    kind = "array<struct<due:bigint,i:int,released:bigint,block:bigint>>"
    start = F.struct(F.transform("s", lambda x, i: turn(i, x["done"])).cast(kind).alias("next"), F.array().cast(kind).alias("taken"))
    slots = F.sequence(F.lit(0).cast("long"), F.col("length") - 1)
    taken = states.select("begin", "s", F.aggregate(slots, start, run, lambda x: x["taken"]).alias("taken"))
    # A plain posexplode would add a filter on `taken` below the caller's repartition: the fold, run twice.
    rows = taken.select("begin", "s", F.posexplode_outer("taken").alias("at", "x"))
    return rows.select(
        F.get(F.col("s"), F.col("x.i"))["name"].alias("name"),
        F.col("x.block").alias("block"),
        "begin",
        (F.col("begin") + F.col("at")).alias("slot"),
        F.col("x.released").alias("released"),
        F.col("x.due").alias("due"),
    )


def _scheduled(sizes: DataFrame, block_rows: int, cycle: int) -> DataFrame:
    """name, block, slot, released, due, before (the rows in earlier slots) for sources of `rows` rows."""
    spark = sizes.sparkSession
    states = stored(cycle_states(sizes.select("name", _up(F.col("rows"), block_rows).alias("b")), cycle), "mix-cycles")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = cycle_schedule(states.repartition(tasks, "begin")).join(sizes, "name")
    held = stored(plan.withColumn("held", F.least(F.lit(block_rows), F.col("rows") - F.col("block") * block_rows)), "mix-schedule")
    cycles = held.groupBy("begin").agg(F.sum("held").alias("all"))
    earlier = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # a row per cycle
    begins = cycles.select("begin", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("begin").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("rows_before") + F.coalesce(F.sum("held").over(within), F.lit(0))
    return held.join(begins, "begin").select("name", "block", "slot", "released", "due", before.alias("before"))


def _ranked(docs: DataFrame, own: list[str], weights: dict[str, int] | None) -> tuple[DataFrame, DataFrame]:
    """The rows with __name, __rank within their source and __target (null without weight); the targets."""
    named = docs.select(*own).withColumn("__name", F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = named.withColumn("__order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    total = docs.count()
    digits = next((d for d in range(1, MOST_DIGITS) if total <= CELL_ROWS * 16**d), MOST_DIGITS)
    rows = rows.withColumn("__cell", F.substring("__order", 1, digits))
    cells = stored(rows.groupBy("__name", "__cell").agg(F.count("*").alias("n")), "mix-cells")
    counts = cells.groupBy(F.col("__name").alias("name")).agg(F.sum("n").alias("n"))
    targets = stored(source_targets(counts, weights), "mix-targets")

    before = Window.partitionBy("__name").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("__name", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__name", "__cell").orderBy("__order", "doc_id")
    ranked = (
        rows.withColumn("__row", F.row_number().over(within) - 1)
        .join(offsets, ["__name", "__cell"])
        .withColumn("__rank", F.col("__before") + F.col("__row"))
        .join(targets.select(F.col("name").alias("__name"), F.col("target").alias("__target")), "__name", "left")
    )
    return ranked, targets


def mix_sources(
    docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE
) -> DataFrame:
    """All rows of docs with mix_block, mix_released, mix_due, mix_slot, mix_position and in_mix.

    Rows of a source are taken in the order of md5(doc_id), doc_id; mix_block numbers its blocks of
    block_rows rows. in_mix says that the row is within its source's target (see source_targets); the
    last block of a target may be a partial one. The surplus of all sources follows behind the mix, in
    blocks of its own, each source by its share of the surplus. mix_position orders the rows and is
    gapless. Columns of docs with one of these names are replaced.

    Nulls: a null source is the source ''; a null doc_id is ordered like an empty one. Rows with equal
    doc_id and source are interchangeable. Sources without weight get nulls and are not in the mix. An
    empty table gives no rows. Ranks are taken in cells of a source, so a source of any size is dealt
    over many tasks; what grows with the data is one count per source and cell, and one row per block.
    """
    added = ("mix_block", "mix_released", "mix_due", "mix_slot", "mix_position", "in_mix")
    own = [c for c in docs.columns if c not in added]
    ranked, targets = _ranked(docs, own, weights)
    mix = _scheduled(targets.select("name", F.col("target").alias("rows")), block_rows, cycle)
    rest = _scheduled(targets.select("name", (F.col("n") - F.col("target")).alias("rows")), block_rows, cycle)
    sums = targets.agg(F.sum("target"), F.sum(_up(F.col("target"), block_rows))).first()
    rows_in, slots_in = (x or 0 for x in sums)
    shifted = rest.select(
        "name", "block", *[(F.col(c) + slots_in).alias(c) for c in ("slot", "released", "due")], (F.col("before") + rows_in).alias("before")
    )
    places = mix.withColumn("in_mix", F.lit(True)).unionByName(shifted.withColumn("in_mix", F.lit(False)))
    places = places.select(F.col("name").alias("__name"), F.col("in_mix").alias("__in"), F.col("block").alias("__block"), "slot", "released", "due", "before")

    inside = F.coalesce(F.col("__rank") < F.col("__target"), F.lit(False))
    at = F.when(inside, F.col("__rank")).otherwise(F.col("__rank") - F.col("__target"))
    dealt = ranked.withColumn("__in", inside).withColumn("__at", at).withColumn("__block", _div(F.col("__at"), block_rows))
    whole = F.when(F.col("__in"), F.lit(0).cast("long")).otherwise(_up(F.col("__target"), block_rows))
    placed = dealt.join(places, ["__name", "__in", "__block"], "left")
    return placed.select(
        *own,
        (F.col("__block") + whole).alias("mix_block"),
        F.col("released").alias("mix_released"),
        F.col("due").alias("mix_due"),
        F.col("slot").alias("mix_slot"),
        (F.col("before") + F.col("__at") % block_rows).alias("mix_position"),
        F.col("__in").alias("in_mix"),
    )


def mixed(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows of docs that are in the mix, with the columns of docs.

    Only the rows by which a source exceeds its own target go.
    """
    ranked, _ = _ranked(docs, docs.columns, weights)
    return ranked.where(F.col("__rank") < F.col("__target")).select(*docs.columns)


def in_schedule(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows of docs that are in the mix, with the columns of docs, mix_slot and mix_position.

    The schedule is that of mix_sources, made from doc_id and source alone; the other columns are shuffled once,
    to the places. Rows of equal doc_id and source take their places in any order.
    """
    own = [c for c in docs.columns if c not in ("mix_slot", "mix_position")]
    doc = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("__doc")
    name = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__name")
    placed = mix_sources(docs.select("doc_id", "source"), weights).where("in_mix")
    places = placed.select(doc, name, F.struct("mix_position", "mix_slot").alias("__at"))
    places = places.groupBy("__doc", "__name").agg(F.sort_array(F.collect_list("__at")).alias("__places"))
    same = Window.partitionBy("__doc", "__name").orderBy(F.lit(0))
    rows = docs.select(*own, doc, name).withColumn("__nth", F.row_number().over(same) - 1)
    dealt = rows.join(places, ["__doc", "__name"]).withColumn("__at", F.get("__places", F.col("__nth")))
    return dealt.where(F.col("__at").isNotNull()).select(*own, F.col("__at.mix_slot").alias("mix_slot"), F.col("__at.mix_position").alias("mix_position"))
