"""Rows whose key may be in a table of keys, told from the others by a bitmap instead of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.scratch import stored

BITS_A_KEY = 32
MOST_BITS = 1 << 29  # 64 MB in the broadcast; with more keys than fit, more rows than needed pass
_PIECE = 32768  # bits of one bitmap of bitmap_construct_agg


def by_keys(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key may be one of `keys`, the rows whose key is none of them); columns as given.

    key: a long that is never null. keys: one column of longs, each its own row. A key that is in `keys` always passes; another passes by
    chance, one in 32 or fewer. So a join with the first part finds all that a join with `rows` finds.
    """
    bits = _PIECE
    while bits < min(MOST_BITS, BITS_A_KEY * keys.count()):
        bits *= 2
    bit = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    pieces = stored(
        keys.select(F.floor(bit / _PIECE).alias("__piece"), (bit % _PIECE).alias("__bit"))
        .groupBy("__piece")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits")),
        "key-bits",
    )
    own = rows.withColumn("__own_bit", F.pmod(key, F.lit(bits)))
    joined = own.join(F.broadcast(pieces), F.floor(F.col("__own_bit") / _PIECE) == F.col("__piece"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__own_bit % 32768 div 8 + 1 AS int), 1)")), 16, 10).cast("long")
    held = F.coalesce(F.expr("getbit(__byte, cast(__own_bit % 8 AS int)) = 1"), F.lit(False))
    marked = joined.withColumn("__byte", byte).withColumn("__held", held)
    own_columns = ["__own_bit", "__piece", "__bits", "__byte", "__held"]
    return marked.where("__held").drop(*own_columns), marked.where("NOT __held").drop(*own_columns)
