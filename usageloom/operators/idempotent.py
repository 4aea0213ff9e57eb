"""Insert-or-ignore and keep-latest on plain Parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate, not a window: copies of one key shrink to one row per task
    before the shuffle, however many there are.
    """
    return (
        rows.groupBy(*key)
        .agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    return (
        rows.groupBy(*key)
        .agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def not_stored(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key the stored table lacks.

    The stored keys are first cut down to those in the batch. A small batch is
    then broadcast by the planner and the large table is not shuffled.
    """
    key = list(key)
    seen = stored.select(*key).join(rows.select(*key), key, "left_semi")
    return rows.join(seen, key, "left_anti")


Stored = DataFrame | Callable[[DataFrame], DataFrame]


def insert_new_events(
    batch: DataFrame,
    stored: Stored,
    key: Sequence[str],
    order: Sequence[str],
    keep: Callable[[DataFrame], DataFrame] = lambda first: first,
) -> DataFrame:
    """The batch rows to append: first of each new key.

    ``stored`` is a table, or a function that leaves the rows whose key is not
    stored. The first rows are read more than once, for the stored keys and for
    the rest; a job passes a ``keep`` that stages them, so that they are found once.
    """
    first = keep(first_per_key(batch, key, order))
    return stored(first) if callable(stored) else not_stored(first, stored, key)


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """(events_inserted, events_skipped) of one insert."""
    both = batch.select(F.lit(0).alias("inserted")).unionAll(inserted.select(F.lit(1)))
    return both.agg(
        F.count_if(F.col("inserted") == 1).alias("events_inserted"),
        (F.count_if(F.col("inserted") == 0) - F.count_if(F.col("inserted") == 1)).alias(
            "events_skipped"
        ),
    )


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, or whose size or time differs from the manifest."""
    state = ["tool", "path", "size_bytes", "modified_at"]
    return listing.join(manifest.select(*state), state, "left_anti")


def upsert_manifest(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """The manifest with updated files replaced; one row per (tool, path)."""
    merged = manifest.unionByName(updates, allowMissingColumns=True)
    return latest_per_key(merged, ("tool", "path"), ("scanned_at",))


def manifest_rows(changed: DataFrame, events: DataFrame, errors: DataFrame, last_lines: DataFrame, scanned_at) -> DataFrame:
    """Manifest entries of the files just read."""
    seen = events.groupBy(F.col("source_path").alias("path")).agg(
        F.max_by("event_ts", "line_number").alias("last_event_ts")
    )
    failed = errors.groupBy("path").agg(F.max_by("message", "line").alias("last_error"))
    return (
        changed.select("tool", "path", "size_bytes", "modified_at")
        .join(last_lines, "path", "left")
        .join(seen, "path", "left")
        .join(failed, "path", "left")
        .select(
            "tool",
            "path",
            "size_bytes",
            "modified_at",
            F.coalesce("last_line", F.lit(0)).cast("bigint").alias("last_line"),
            "last_event_ts",
            F.when(F.col("last_error").isNull(), "active").otherwise("error").alias("status"),
            "last_error",
            F.lit(scanned_at).cast("timestamp").alias("scanned_at"),
        )
    )


def merge_ingest_results(results: DataFrame) -> DataFrame:
    """Totals of several runs; the status is an error if any run had one."""
    total = ("files_scanned", "files_changed", "events_inserted", "events_skipped", "errors")
    sums = results.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in total])
    return sums.withColumn("status", F.when(F.col("errors") == 0, "ok").otherwise("error"))
