"""Device outbox: what to upload next, in envelopes, and how far a device got."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.functions.instants import canonical_instant
from usageloom.functions.texts import is_blank
from usageloom.model import COLLECTOR_VERSION, LOOKBACK_DAYS, MAX_ENVELOPE_EVENTS, TOKENS
from usageloom.operators.rank import ranked


def same_device(other: DataFrame) -> tuple[DataFrame, Column]:
    """The other side with its device columns renamed, and the null-safe condition to join it on."""
    own = other.withColumnsRenamed({"user_id": "_user", "device_id": "_device"})
    return own, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("device_id").eqNullSafe(F.col("_device"))


def upload_batches(events: DataFrame, batch: int = MAX_ENVELOPE_EVENTS) -> DataFrame:
    """Add ``batch_no``: a device's events by time and key, ``batch`` to an envelope."""
    size = max(1, min(MAX_ENVELOPE_EVENTS, batch))
    placed = ranked(
        events,
        order=(F.col("event_ts").asc(), F.col("event_key").asc()),
        within=("user_id", "device_id"),
        name="place",
    )
    return placed.withColumn("batch_no", F.floor((F.col("place") - 1) / size)).drop("place")


def upload_outbox(
    events: DataFrame, devices: DataFrame, batch: int = MAX_ENVELOPE_EVENTS
) -> DataFrame:
    """Envelope documents per device; a device without events sends an empty one.

    An array holds at most ``batch`` events, so no group outgrows its envelope.
    """
    item = F.struct(
        "event_key",
        "tool",
        "session_id",
        "model",
        canonical_instant(F.col("event_ts")).alias("timestamp"),
        *TOKENS,
        *[
            F.when(~is_blank(F.col(c)), F.col(c)).alias(c)
            for c in ("source_kind", "source_quality")
        ],
    )
    placed = F.struct("event_ts", "event_key", item.alias("item"))
    filled = (
        upload_batches(events, batch)
        .groupBy("user_id", "device_id", "batch_no")
        .agg(F.sort_array(F.collect_list(placed)).alias("_placed"))
        .withColumn("events", F.transform("_placed", lambda p: p["item"]))
    )
    empty = F.from_json(F.lit("[]"), filled.schema["events"].dataType)
    every = devices.select("user_id", "device_id").distinct()
    return every.join(*same_device(filled), "left").select(
        "user_id",
        "device_id",
        F.coalesce("batch_no", F.lit(0)).alias("batch_no"),
        F.coalesce(F.size("events"), F.lit(0)).alias("event_count"),
        F.to_json(
            F.struct(
                F.lit(COLLECTOR_VERSION).alias("collector_version"),
                F.col("user_id").alias("client_user_id"),
                F.col("device_id").alias("client_device_id"),
                F.coalesce("events", empty).alias("events"),
            )
        ).alias("body"),
    )


def pending_after_cursor(
    events: DataFrame,
    cursors: DataFrame,
    cutoff: str,
    today: date,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """Events after their device's cursor, by (time, key), up to the cutoff instant.

    A device without a cursor starts at the lookback window, by local date.
    """
    since = today - timedelta(days=lookback_days - 1)
    after = F.struct("event_ts", "event_key") > F.struct("cursor_ts", "cursor_key")
    start = F.col("cursor_ts").isNull() & (F.col("local_date") >= F.lit(since))
    return (
        events.filter(F.col("event_ts") <= F.lit(cutoff).cast("timestamp"))
        .join(*same_device(cursors), "left")
        .filter(start | (F.col("cursor_ts").isNotNull() & after))
        .select(*events.columns)
    )


def advance_cursor(cursors: DataFrame, selected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Move a device's cursor to its last selected event once all were acknowledged.

    ``outcomes`` has one row per device: (user_id, device_id, ok, rejected). A
    failed run, a rejected event or an empty run leaves the cursor where it was.
    """
    device = ["user_id", "device_id"]
    done = outcomes.filter(F.col("ok") & (F.col("rejected") == 0)).select(*device)
    reached = (
        selected.groupBy(*device)
        .agg(F.max(F.struct("event_ts", "event_key")).alias("_reached"))
    )
    moved = reached.join(*same_device(done), "left_semi")
    return cursors.join(*same_device(moved), "full").select(
        F.coalesce("user_id", "_user").alias("user_id"),
        F.coalesce("device_id", "_device").alias("device_id"),
        F.coalesce("_reached.event_ts", "cursor_ts").alias("cursor_ts"),
        F.coalesce("_reached.event_key", "cursor_key").alias("cursor_key"),
    )
