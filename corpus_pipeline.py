"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.exact_dedup import without_copies
from tillroll.llm.language import identified
from tillroll.llm.ngram_join import one_of_each
from tillroll.llm.packing import pack, token_pieces
from tillroll.llm.scratch import stored
from tillroll.llm.source_mix import in_schedule

BATCH_BYTES = 4 << 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """Whole texts go to Python in batches of a few MB. Spark's 10,000 rows are held several times over: by the JVM
    beside its heap, in buffers that double, and by the worker. The setting is the session's from then on, as a stage
    is planned when it is written."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay."""
    return identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest doc_id stays."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 5-word shingles at a Jaccard similarity of 0.8, the least doc_id stays."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the target weights of the sources go; the rest get their places in the schedule."""
    return in_schedule(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it lies in the sequences of 1024 ids, and its document's place in the mix."""
    places = ("mix_slot", "mix_position")
    pieces = token_pieces(docs, also=places)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *places))


STAGES = [
    ("language_id", _in_small_batches(language_id)),
    ("exact_dedup", _in_small_batches(exact_dedup)),
    ("near_dedup", _in_small_batches(near_dedup)),
    ("source_mix", _in_small_batches(source_mix)),
    ("packing", _in_small_batches(packing)),
]

# Language identification is a trained model, and tokens are not SQL: tests compare the other stages with
# brute force on small fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
