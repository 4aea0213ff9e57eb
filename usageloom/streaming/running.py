"""Running aggregates over streams of events and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usageloom.functions.instants import local_date
from usageloom.model import ACTIVE_GAP_SECONDS, DEVICE, TEAM, TOKENS


def stream_daily_rollup(events: DataFrame, zone: str) -> DataFrame:
    """Running sums per local date, team and tool.

    Events of any age count, as in the batch report, so there is no watermark;
    state is one row per date, team and tool. ``closing_days`` is the bounded form.
    """
    return events.groupBy(
        local_date(F.col("event_ts"), zone).alias("local_date"), "team_id", "tool"
    ).agg(
        *[F.sum(t).alias(t) for t in TOKENS],
        F.count(F.lit(1)).alias("usage_event_count"),
    )


def stream_upload_health(uploads: DataFrame) -> DataFrame:
    """Latest upload of each device so far; age and status depend on when it is read."""
    newest = F.max(F.struct("upload_time", "status", "accepted", "duplicate", "rejected"))
    return (
        uploads.groupBy(*DEVICE)
        .agg(newest.alias("u"))
        .select(
            *DEVICE,
            F.col("u.upload_time").alias("last_upload_at"),
            *[
                F.col(f"u.{c}").alias(f"latest_{c}")
                for c in ("status", "accepted", "duplicate", "rejected")
            ],
        )
    )


def _stretches(events: DataFrame, horizon: str) -> DataFrame:
    seconds = events.withColumn("second", F.date_trunc("second", "event_ts"))
    stretch = F.session_window("second", f"{ACTIVE_GAP_SECONDS} seconds")
    return (
        seconds.withWatermark("second", horizon)
        .groupBy(*TEAM.session, stretch.alias("stretch"))
        .agg(F.count(F.lit(1)).alias("usage_event_count"), F.max("second").alias("_last"))
    )


def _measured(stretches: DataFrame) -> DataFrame:
    """A window reaches one gap beyond its last event; the gap is taken off again."""
    length = F.unix_seconds("stretch.end") - F.unix_seconds("stretch.start") - ACTIVE_GAP_SECONDS
    return stretches.select(
        *TEAM.session, F.col("stretch.start").alias("started_at"), length.alias("active_seconds"), "usage_event_count"
    )


def stream_active_time(events: DataFrame, horizon: str) -> DataFrame:
    """Stretches of activity per session, closed once ``horizon`` has passed.

    A window takes in an event that falls exactly on its end, so on whole seconds
    its gap is the limit itself. In append mode a stretch comes out once, when the
    watermark has passed its end, and its state goes then; ``open_stretches`` are
    those still held back, and ``late_rows`` counts what came after its stretch
    had closed.
    """
    return _measured(_stretches(events, horizon))


def watermark_of(query: StreamingQuery) -> str | None:
    """The last watermark of a query, as a timestamp text; none before any event."""
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    return max(marks, default=None)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped, over the query's recent batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def open_stretches(events: DataFrame, watermark: str | None) -> DataFrame:
    """Stretches that end after the watermark: what append mode holds back, from the stored events.

    The condition is on the last event, an aggregate. One on the window's end is a
    condition on a grouping column: it is pushed below the merging of windows, and
    a stretch loses its early events.
    """
    every = _stretches(events, "0 seconds")
    if watermark is not None:
        end = F.col("_last") + F.expr(f"INTERVAL {ACTIVE_GAP_SECONDS} SECONDS")
        every = every.where(end > F.lit(watermark).cast("timestamp"))
    return _measured(every)


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str, every: str | None = None
) -> StreamingQuery:
    """Write each batch, tagged with its id, to its own directory of a table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
