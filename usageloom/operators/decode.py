"""Log records to canonical usage events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.functions.instants import local_date
from usageloom.functions.keys import message_event_key, snapshot_event_key
from usageloom.functions.texts import file_stem, has_positive_usage, known_model
from usageloom.model import LOCAL_EVENT_COLUMNS, MESSAGE_TOOL, SNAPSHOT_TOOL, TOKENS, UNKNOWN
from usageloom.operators.idempotent import first_per_key
from usageloom.operators.series import SEGMENT_ROWS, carry_along
from usageloom.sources.message_log import tag_source


def carry_context(records: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Session, model and previous snapshot of every snapshot-log record.

    The session is the last one announced so far, else the file's stem. The
    model is the last one named so far; where that is not a known model, the
    file's first known one.
    """
    carried = carry_along(
        records.select(
            "path", "line_no", "event_ts", "session_meta_id", "context_model", "cumulative"
        ),
        "path",
        "line_no",
        last=("session_meta_id", "context_model"),
        previous=("cumulative",),
        first={"known_model": known_model(F.col("context_model"))},
        segment_rows=segment_rows,
    )
    return carried.select(
        "path",
        "line_no",
        "event_ts",
        "cumulative",
        "previous_cumulative",
        F.coalesce("last_session_meta_id", file_stem(F.col("path"))).alias("session_id"),
        backfill_model(
            F.coalesce("last_context_model", F.lit(UNKNOWN)), F.col("first_known_model")
        ).alias("model"),
    )


def backfill_model(model: Column, first_known: Column) -> Column:
    return F.coalesce(known_model(model), first_known, model)


def clamped_delta(cumulative: Column, previous: Column) -> list[Column]:
    """Per counter: the growth since the previous snapshot, never below zero."""
    zero = F.lit(0).cast("bigint")
    return [
        F.when(previous.isNull(), cumulative[t])
        .otherwise(F.greatest(zero, cumulative[t] - previous[t]))
        .alias(t)
        for t in TOKENS
    ]


def cumulative_to_delta(carried: DataFrame) -> DataFrame:
    """Valid token snapshots to per-record usage; records without growth are dropped."""
    keep = [c for c in carried.columns if c not in TOKENS]
    return (
        carried.filter(F.col("cumulative").isNotNull())
        .select(*keep, *clamped_delta(F.col("cumulative"), F.col("previous_cumulative")))
        .filter(has_positive_usage())
    )


def snapshot_events(records: DataFrame, zone: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Snapshot-log records to usage events."""
    deltas = cumulative_to_delta(carry_context(records, segment_rows))
    keyed = deltas.select(
        snapshot_event_key(
            F.col("session_id"), F.col("path"), F.col("line_no"), F.col("cumulative")
        ).alias("event_key"),
        F.lit(SNAPSHOT_TOOL).alias("tool"),
        "session_id",
        "model",
        "event_ts",
        local_date(F.col("event_ts"), zone).alias("local_date"),
        *TOKENS,
        F.col("path").alias("source_path"),
        F.col("line_no").alias("line_number"),
    )
    return tag_source(keyed, "snapshot").select(*LOCAL_EVENT_COLUMNS)


def message_events(records: DataFrame, zone: str, mode: str = "local") -> DataFrame:
    """Message-log records to usage events, one per key across all files.

    An unknown model takes the first known model of its file. Keys are built
    after that, so a backfilled row and its replay agree.
    """
    first_known = (
        records.filter(F.col("line_model").isNotNull())
        .groupBy("path")
        .agg(F.min_by("line_model", "line_no").alias("_first_known"))
    )
    usage = records.filter(F.col("shape").isin("message", "tool_result", "flat"))
    filled = tag_source(
        usage.join(first_known, "path", "left").withColumn(
            "model", backfill_model(F.col("model"), F.col("_first_known"))
        ),
        mode,
    )
    keyed = filled.select(
        message_event_key(
            F.col("source_kind"), F.col("session_id"), F.col("identity"), F.col("model")
        ).alias("event_key"),
        F.lit(MESSAGE_TOOL).alias("tool"),
        "session_id",
        "model",
        "event_ts",
        local_date(F.col("event_ts"), zone).alias("local_date"),
        *TOKENS,
        "source_kind",
        "source_quality",
        F.col("path").alias("source_path"),
        F.col("line_no").alias("line_number"),
    ).select(*LOCAL_EVENT_COLUMNS)
    return first_per_key(keyed, ("event_key",), ("source_path", "line_number"))


def all_tool_events(
    snapshot: DataFrame, message: DataFrame, start: date, end: date
) -> DataFrame:
    """Events of both logs inside a closed range of local dates."""
    return snapshot.unionByName(message).filter(
        F.col("local_date").between(F.lit(start), F.lit(end))
    )


def decode_errors(records: DataFrame) -> DataFrame:
    """(path, line, message) of snapshot-log records that could not be read."""
    return records.filter(F.col("error").isNotNull()).select(
        "path", F.col("line_no").alias("line"), F.col("error").alias("message")
    )


def dropped_lines(records: DataFrame) -> DataFrame:
    """Message-log lines dropped without an error row, counted per file."""
    return records.groupBy("path").agg(
        F.count_if(F.coalesce("dropped", F.lit(False))).alias("dropped_lines")
    )


__all__ = [
    "all_tool_events",
    "backfill_model",
    "carry_context",
    "clamped_delta",
    "cumulative_to_delta",
    "decode_errors",
    "dropped_lines",
    "message_events",
    "snapshot_events",
]
