"""Log lines with their numbers, read by Spark's splittable text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from usageloom.functions.texts import decoded_path, is_blank


def file_listing(spark: SparkSession, paths: str | list[str], tool: str) -> DataFrame:
    """(tool, path, size_bytes, modified_at) of every log file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .load(paths)
        .select(
            F.lit(tool).alias("tool"),
            decoded_path(F.col("path")).alias("path"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
            F.col("path").alias("uri"),
        )
    )


def session_lines(
    spark: SparkSession, paths: str | list[str], keep: Column | None = None
) -> DataFrame:
    """(path, line_no, line) of all ``*.jsonl`` files below ``paths``.

    Line numbers count from one and include blank lines, which are dropped
    afterwards. A file is read in blocks by many tasks: each line gets its place
    within its block, and the lines of earlier blocks are added from a count per
    block. Only lines passing ``keep`` are shuffled.

    The running id is non-deterministic in Catalyst's eyes, so no filter moves
    below it and both reads see the same blocks.
    """
    blocks = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .text(paths)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("_uri"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_running"),
        )
    )
    earlier = Window.partitionBy("_uri").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        blocks.groupBy("_uri", "_block")
        .agg(F.min("_running").alias("_first"), F.count(F.lit(1)).alias("_lines"))
        .withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
        .drop("_lines")
    )
    wanted = ~is_blank(F.col("line"))
    if keep is not None:
        wanted = wanted & keep
    missing = F.raise_error(F.lit("block start not found")).cast("bigint")
    return (
        blocks.filter(wanted)
        .join(starts, ["_uri", "_block"], "left")
        .select(
            decoded_path(F.col("_uri")).alias("path"),
            F.coalesce(F.col("_before") + F.col("_running") - F.col("_first") + 1, missing).alias(
                "line_no"
            ),
            "line",
        )
    )


def file_line_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, last_line): every line of a file counts, blank ones too."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .text(paths)
        .groupBy(decoded_path(F.col("_metadata.file_path")).alias("path"))
        .agg(F.count(F.lit(1)).alias("last_line"))
    )
