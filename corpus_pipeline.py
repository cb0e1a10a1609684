"""The corpus pipeline: documents to training tokens, in stages that are each written and read again.

Each stage works on all that the one before kept and returns the columns of
``documents``; the last returns tokens.  A null text has no words and is
rejected by the first stage.  Rows without a doc_id stay through the second
stage, as they are no one's duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.near_dup import drop_near_duplicates
from sheetloom.llm.pieces import coded_column
from sheetloom.llm.pii import redact_documents
from sheetloom.llm.quality_rules import filter_documents
from sheetloom.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_keys, piece_model
from sheetloom.llm.source_mix import mix_documents
from sheetloom.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The share of all tokens that the mix holds; nothing is repeated.
MIX_PERCENT = 90


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by the name of their kind; no document goes."""
    return redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights, as far as the budget goes."""
    return mix_documents(docs, mix_keys(), MIX_WEIGHTS, percent=MIX_PERCENT, max_epochs=1, seed=MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and whether they decode to the text."""
    model = piece_model()
    coded = docs.select("doc_id", "text", coded_column(docs, F.col("text"), model).alias("c"))
    return coded.select(
        "doc_id", F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", F.coalesce(F.col("c.decoded") == F.col("text"), F.lit(False)).alias("round_trip")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("source_mix", mix),
    ("sentencepiece", tokens),
]

#: Near-duplicate components and subword tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
