"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visionloom.llm import decontaminate, langid, packing, pii, shingles
from visionloom.llm.common import remove, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are null, without letters or of no recognised language; lang becomes the recognised one.

    The least score follows the learned languages (langid.least_score). Repeated rows are treated alike; where no document
    has a lang nothing is recognised, so nothing stays; an empty table stays empty."""
    net = langid.fit(docs)
    least = net.least if net else 0.0
    found = langid.identify(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return _documents(found.withColumn("lang", F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity 0.8 or more) one row, with the smallest id.

    Null and empty texts are copies of each other; rows without an id stay only where no copy has one."""
    return _documents(shingles.first_of_near_copies(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a document that is little else goes. Null texts and repeated rows stay."""
    return _documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, all base spans and what the models select. Every row stays, null texts as null."""
    return _documents(pii.redact(docs, pii.fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row per piece. Null texts pack as their end id alone, repeated
    rows as documents of their own; an empty table packs to no rows."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: Trained models and tokenizers have no SQL; tests/llm holds the stages against plain loops over small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes once the next is written; the last one and what the packing keeps
    stay until llm.common.cleanup."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
