"""Session settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings a cluster job should run with. Lookups are broadcast by the planner itself, only when
# their measured size is below the threshold; above it the join shuffles and AQE splits hot keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def local_session(
    cores: int | str = 8,
    memory: str = "8g",
    shuffle_partitions: int | None = None,
    warehouse: str | None = None,
) -> SparkSession:
    """A single-machine session for tests and benchmarks; without a warehouse folder, in a new one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillroll")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.warehouse.dir", warehouse or tempfile.mkdtemp(prefix="tillroll-wh-"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
