"""The collector: what a device's uploads have reached, and what is on its way.

A run first commits its outbox: the envelopes, and the event each device will
have reached with them. Then it sends. The replies and the moved cursors are
committed together. A run that finds a committed outbox without replies sends
the same envelopes again, so a lost reply neither skips events (the cursor has
not moved) nor doubles them (the receiver knows their keys).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.model import MAX_ENVELOPE_EVENTS
from usageloom.operators.idempotent import latest_per_key
from usageloom.operators.outbox import advance_cursor, pending_after_cursor, same_device, upload_outbox
from usageloom.plans.store import Attempt, Tables, committed_since, read_commits
from usageloom.session import stage

_DEVICE = ("user_id", "device_id")


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in _DEVICE] + [T.StructField(*c) for c in columns])


OUTBOX_SCHEMA = _schema(("batch_no", T.LongType()), ("event_count", T.IntegerType()), ("body", T.StringType()))
REACHED_SCHEMA = _schema(("event_ts", T.TimestampType()), ("event_key", T.StringType()))
CURSOR_SCHEMA = _schema(("cursor_ts", T.TimestampType()), ("cursor_key", T.StringType()))
REPLY_SCHEMA = _schema(
    ("batch_no", T.LongType()), ("ok", T.BooleanType()), ("accepted", T.LongType()), ("duplicate", T.LongType()), ("rejected", T.LongType())
)

#: Sends envelopes; a reply per envelope, in the columns of ``REPLY_SCHEMA``.
Send = Callable[[DataFrame], DataFrame]


def current_cursors(spark: SparkSession, tables: Tables) -> DataFrame:
    """Where each device is: its cursor of the last commit that moved it."""
    rows = committed_since(spark, tables.cursors, CURSOR_SCHEMA, 0, [])
    return latest_per_key(rows, _DEVICE, ("seq",)).select(*CURSOR_SCHEMA.names)


def _outbox_run(run_id: int | str) -> str:
    return f"{run_id} outbox"


def open_outbox(spark: SparkSession, tables: Tables):
    """The commit of an outbox that has no replies yet, or none."""
    commits = read_commits(spark, tables)
    sent = commits.where(F.col("run_id").endswith(" outbox"))
    replied = commits.where(F.col("run_id").endswith(" replies")).select(F.regexp_replace("run_id", " replies$", " outbox").alias("run_id"))
    return sent.join(replied, "run_id", "left_anti").orderBy("seq").first()


def run_collector(
    spark: SparkSession,
    events: DataFrame,
    devices: DataFrame,
    tables: Tables,
    send: Send,
    cutoff: str,
    today: date,
    run_id: int | str,
    batch: int = MAX_ENVELOPE_EVENTS,
) -> DataFrame:
    """One run: send what is open, or else what is new since the cursors; returns its replies.

    A device whose envelopes were all stored and wholly accepted moves to its
    last event; a failed or partly rejected one stays and sends again next time.
    Devices without new events send an empty envelope and stay. Repeating a
    committed run returns its replies and sends nothing.
    """
    done = read_commits(spark, tables).where(F.col("run_id") == f"{run_id} replies").first()
    if done is not None:
        return spark.read.schema(REPLY_SCHEMA).parquet(f"{tables.replies}/attempt={done.attempt}")
    cursors = current_cursors(spark, tables)
    opened = open_outbox(spark, tables)
    if opened is None:
        selected = stage(spark, pending_after_cursor(events, cursors, cutoff, today), "pending")
        attempt = Attempt.begin(spark, tables, _outbox_run(run_id))
        attempt.write(upload_outbox(selected, devices, batch).select(*OUTBOX_SCHEMA.names), tables.outbox)
        reached = selected.groupBy(*_DEVICE).agg(F.max(F.struct("event_ts", "event_key")).alias("_r")).select(*_DEVICE, "_r.*")
        attempt.write(reached, tables.reached)
        attempt.commit()
        opened = open_outbox(spark, tables)
    envelopes = spark.read.schema(OUTBOX_SCHEMA).parquet(f"{tables.outbox}/attempt={opened.attempt}")
    reached = spark.read.schema(REACHED_SCHEMA).parquet(f"{tables.reached}/attempt={opened.attempt}")
    replies = stage(spark, send(envelopes).select(*REPLY_SCHEMA.names), "replies")
    attempt = Attempt.begin(spark, tables, opened.run_id.removesuffix(" outbox") + " replies")
    attempt.write(replies, tables.replies)
    moved = advance_cursor(cursors, reached, _outcomes(envelopes, replies))
    changed = moved.join(*same_device(reached), "left_semi")
    attempt.write(changed.select(*CURSOR_SCHEMA.names), tables.cursors)
    attempt.commit()
    return replies


def _outcomes(envelopes: DataFrame, replies: DataFrame) -> DataFrame:
    """(user_id, device_id, ok, rejected) per device; an envelope without a reply has failed."""
    own = replies.withColumnsRenamed({"user_id": "_user", "device_id": "_device", "batch_no": "_batch"})
    same = (
        F.col("user_id").eqNullSafe(F.col("_user")) & F.col("device_id").eqNullSafe(F.col("_device")) & (F.col("batch_no") == F.col("_batch"))
    )
    answered = envelopes.join(own, same, "left")
    return answered.groupBy(*_DEVICE).agg(
        F.min(F.coalesce("ok", F.lit(False))).alias("ok"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected")
    )
