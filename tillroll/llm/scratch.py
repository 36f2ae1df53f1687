"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; the warehouse folder where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tillroll-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as parquet to the shared folder and read it back.

    This cuts the lineage: a later stage that loses an executor rereads the files instead of computing
    everything anew, and a table that is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
