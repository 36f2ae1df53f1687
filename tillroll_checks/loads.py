"""Loads of files that Spark writes from the driver tables, for queries that check jobs which write.

Files of one month of sales, as a store sends them: everything up to a day, under that day's name. They come
in the order 10, 20, 5, and 20 once more: the 10th is replaced by the 20th, the 5th comes too late, and the
repeated 20th is skipped. The month is closed after the 10th already, so that the 20th replaces a closed file,
and once more at the end.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans.load import FileLoad, load_file
from tillroll.sources.landing import SEPARATORS
from tillroll.sources.schemas import COLLECTION_AUDIT, MONITOR_CONFIG, ddl, raw_widths
from tillroll.sources.tables import RevenueTables
from tillroll_checks.inputs import view

MONTH = "1996-03"
LOADED_AS_OF = date(1996, 6, 15)
DAYS = (10, 20, 5, 20)
_LOADED: dict[tuple[str, str], RevenueTables] = {}


def scratch_tables(spark: SparkSession) -> RevenueTables:
    """A new database in the session's warehouse."""
    tables = RevenueTables(spark, f"checks_{uuid.uuid4().hex}")
    tables.create()
    return tables


def _written(tables: RevenueTables, rows: DataFrame, provider: str, name: str) -> str:
    """The rows as a provider's text file, in the database's own folder: one part a task, each with the header."""
    folder = tables.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{folder}/{tables.database}_files/{name}"
    columns = rows.select(*raw_widths(provider))
    columns.write.option("header", True).option("sep", SEPARATORS[provider]).option("escape", '"').csv(path)
    return path


def loaded(spark: SparkSession, sf_dir: str) -> RevenueTables:
    """The tables after all loads, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        _LOADED[key] = _load(scratch_tables(spark), sf_dir)
    return _LOADED[key]


def _load(tables: RevenueTables, sf_dir: str) -> RevenueTables:
    spark = tables.spark
    config = [("m", "ENABLED", "Amazon", "SALES", 6, None, None, None, None, None)]
    tables.append("monitor_config_log", spark.createDataFrame(config, ddl(MONITOR_CONFIG)))
    year, month = map(int, MONTH.split("-"))
    collected = [
        (f"d{day}", "Amazon_AMER", "SALES", f"amazon_go_sales_{MONTH}-{day:02d}.csv", datetime(year, month, day), 100)
        for day in sorted(set(DAYS))
    ]
    tables.append("collection_audit", spark.createDataFrame(collected, ddl(COLLECTION_AUDIT)))
    sales = view(spark, sf_dir, "raw_amazon").where(F.substring("transaction_time", 1, 7) == MONTH)
    for n, day in enumerate(DAYS):
        if DAYS.index(day) == n:
            part = sales.where(F.substring("transaction_time", 9, 2).cast("int") <= day)
            path = _written(tables, part, "amazon", f"amazon_go_sales_{MONTH}-{day:02d}.csv")
        else:
            path = f"gone/amazon_go_sales_{MONTH}-{day:02d}.csv"  # a skipped file is not opened
        load_file(tables, FileLoad("amazon", "AMER", path, f"d{day}", as_of=LOADED_AS_OF, monitor_id="m"))
        if n in (0, len(DAYS) - 1):
            tables.close_month(date(year, month, 1))
    apple = view(spark, sf_dir, "raw_apple").where(F.col("file_tx_id") == f"f_Apple_{MONTH}")
    path = _written(tables, apple, "apple", "apple.txt")
    load_file(tables, FileLoad("apple", "AMER", path, "apple", as_of=LOADED_AS_OF))
    return tables
