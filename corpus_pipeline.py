"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. Between stages the rows
are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm import decontamination, language_id, line_dedup, near_dedup, packing
from usageloom.llm.queries import VOCABULARY, reachable
from usageloom.llm.staging import Stage

#: What a task holds at once. All stages run in the same executors, whose memory
#: keeps the size of the largest buffers they ever had: batches handed to Python,
#: rows that a Parquet reader decodes at once, and the row group of a Parquet writer.
BUFFERS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
    "parquet.block.size": 16 << 20,
}


def prepare(spark: SparkSession) -> None:
    """Set the session up for a stage: as for any operator, but with smaller buffers."""
    reachable(spark)
    for key, value in BUFFERS.items():
        spark.conf.set(key, value)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; a missing lang is filled with the prediction."""
    prepare(spark)
    model = language_id.fit_on(docs)
    rows = language_id.with_language(docs.select(F.struct("*").alias("doc"), "text"), model)
    kept = rows.where(F.col("lang_pred") != language_id.UNKNOWN)
    lang = F.coalesce("doc.lang", "lang_pred").alias("lang")
    return kept.select(*[lang if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs; n_chars follows the text where lines went."""
    prepare(spark)
    kept = line_dedup.without_repeats(docs.select(F.struct("*").alias("doc"), "doc_id", "text"))
    size = F.when(F.size("removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    changed = {"text": F.col("text"), "n_chars": size.alias("n_chars")}
    return kept.select(*[changed.get(c, F.col(f"doc.`{c}`").alias(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, found by SimHash and by min-hashes beyond its radius.

    Links are verified: a Jaccard similarity of 0.8 or more of five-word shingles.
    """
    prepare(spark)
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    prepare(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, with their sequences and offsets."""
    prepare(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No stage's method can be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage.keep(function(spark, docs, sf_dir))
    return docs
