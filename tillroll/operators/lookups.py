"""Reference lookups: small tables joined to the payments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_lookup(table: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The table, with a repeated key raising an error when the query runs.

    A second row for a key would multiply the payments it joins to. The test is part of the plan:
    it costs one aggregation of the small side and no extra job. The join that follows carries no
    broadcast hint; the planner broadcasts the side only if its size is below the session's
    threshold, and shuffles otherwise.
    """
    values = [c for c in table.columns if c not in keys]
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    repeated = F.raise_error(F.concat(F.lit(f"{name} repeats the key: "), shown)).cast("boolean")
    return (
        table.groupBy(*keys)
        .agg(F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in values])
        .where(F.when(F.col("_copies") > 1, repeated).otherwise(F.lit(True)))
        .select(*table.columns)
    )
