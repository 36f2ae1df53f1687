"""File extracts for other systems."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv_extract(df: DataFrame, path: str) -> None:
    """A folder of CSV part files, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
