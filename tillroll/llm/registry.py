"""The registered queries of these operators and the SQL that some are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm.chat_format import conflicting, format_conversations, loss_text, turns_text
from tillroll.llm.exact_dedup import exact_duplicates
from tillroll.llm.fingerprints import fingerprint_documents
from tillroll.llm.language import fit_language_model, held_out, predict_language
from tillroll.llm.ngram_join import ngram_jaccard_join
from tillroll.llm.oracle import LLM_SQL
from tillroll.llm.packing import pack, token_pieces
from tillroll.llm.secret_scan import BASE, count_of, scan_secrets, spans_text
from tillroll.llm.shortest_pack import pack_documents
from tillroll.llm.source_mix import mix_sources
from tillroll.llm.spelling import spelling_variants
from tillroll.llm.token_output import document_keys, write_tokens
from tillroll.llm.toxicity import ToxicitySettings, fit_chain, predict_toxicity
from tillroll.llm.whitening import whiten

CATEGORIES = ["low_quality", "toxic"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out()))
    return predict_language(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = format_conversations(turns.unionByName(conflicting(spark)))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text(F.col("turns")), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marked = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    settings = ToxicitySettings()
    chain = fit_chain(docs, marked, CATEGORIES, settings)
    return predict_toxicity(docs, chain, CATEGORIES, ["doc_id"], settings.threshold)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = write_tokens(docs)
    return files.read(document_keys(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_table(spark, sf_dir, "documents"))
    digested = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digested)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join,
    "op2_language": language,
    "op3_exact_dedup": exact_dedup,
    "op4_chat_format": chat_format,
    "op5_toxicity": toxicity,
    "op6_secret_scan": secret_scan,
    "op7_source_mix": source_mix,
    "op8_token_output": token_output,
    "op9_packing": packing,
    "op10_fingerprints": fingerprints,
    "op11_whitening": whitening,
    "op12_spelling": spelling,
    "op13_shortest_pack": shortest_pack,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["LLM_QUERIES", "LLM_SQL"]
