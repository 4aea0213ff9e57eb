"""Session pages from a summary that every commit adds to.

A commit writes, beside its new events, what they change: one row per session
and day with first and last instant (``days``), and its distinct calls with the
number of their events (``calls``), in folders by a hash of the session. Both
merge by minimum, maximum and sum, in any order; only events that were new are
summarised, so a replayed batch adds nothing.

A page finds its sessions in ``days``, a few bytes per session and day, and then
reads the calls of its ten sessions alone. No event is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.model import LOCAL, TOKENS
from usageloom.operators.grains import Grains
from usageloom.plans.local_reports import SESSIONS, newest_first, page_info, session_buckets
from usageloom.plans.periods import Range

#: Folders that the calls of sessions are dealt to.
BUCKETS = 64

DAY_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("local_date", T.DateType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("usage_event_count", T.LongType()),
    ]
)
CALL_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("session_id", "tool", "model")],
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("local_date", T.DateType()),
        *[T.StructField(t, T.LongType()) for t in TOKENS],
        T.StructField("usage_event_count", T.LongType()),
    ]
)
BUCKET = [T.StructField("bucket", T.IntegerType())]
_CALL = [c for c in CALL_SCHEMA.names if c != "usage_event_count"]


def bucket_of(session: str = "session_id"):
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def day_rows(events: DataFrame) -> DataFrame:
    """One row per session and local date."""
    return events.groupBy("session_id", "local_date").agg(
        F.min("event_ts").alias("started_at"), F.max("event_ts").alias("ended_at"), F.count(F.lit(1)).alias("usage_event_count")
    )


def merged_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "local_date").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("usage_event_count").alias("usage_event_count")
    )


def call_rows(events: DataFrame) -> DataFrame:
    """One row per distinct call, with the number of its events and the folder of its session."""
    return events.groupBy(*_CALL).agg(F.count(F.lit(1)).alias("usage_event_count")).withColumn("bucket", bucket_of())


def merged_calls(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_CALL).agg(F.sum("usage_event_count").alias("usage_event_count")).withColumn("bucket", bucket_of())


def write_calls(calls: DataFrame, path: str) -> None:
    """Few files per folder, sorted, so that a session is a short stretch of each.

    Rows are rebalanced, not merely dealt, by folder: the folder of a session with
    a third of all calls is written by many tasks.
    """
    (
        calls.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "session_id", "event_ts")
        .write.partitionBy("bucket")
        .option("parquet.bloom.filter.enabled#session_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


def _within(rows: DataFrame, span: Range) -> DataFrame:
    return rows.where(F.col("local_date").between(F.lit(span.start), F.lit(span.end)))


def sessions_of(calls: DataFrame) -> DataFrame:
    """Session rows with all metrics, tools and models, from calls in any number of parts."""
    base = calls.groupBy(*LOCAL.call).agg(F.sum("usage_event_count").alias("usage_event_count"))
    return session_buckets(base, Grains.of_calls(base, LOCAL, (SESSIONS,)))


def summary_sessions(calls: DataFrame, span: Range) -> DataFrame:
    """All sessions of a range, newest first."""
    return sessions_of(_within(calls, span)).orderBy(*newest_first())


def summary_page(
    days: DataFrame, calls: DataFrame, span: Range, page: int = 1, page_size: int = 10
) -> tuple[DataFrame, DataFrame]:
    """One page of sessions, newest first, and the one-row page information.

    Dates are those of the zone the store was written in. The ids of the page,
    ten at most, are read first: they choose folders and stretches of files.
    """
    own = _within(days, span)
    info = page_info(own.select("session_id").distinct(), page, page_size)
    starts = own.groupBy("session_id").agg(F.min("started_at").alias("started_at"))
    chosen = starts.orderBy(*newest_first()).offset((page - 1) * page_size).limit(page_size)
    found = chosen.select("session_id", bucket_of().alias("bucket")).collect()
    ids, buckets = [r.session_id for r in found if r.session_id is not None], sorted({r.bucket for r in found})
    wanted = F.col("session_id").isin(ids)
    if len(ids) < len(found):
        wanted = wanted | F.col("session_id").isNull()
    near = _within(calls.where(F.col("bucket").isin(buckets)), span).where(wanted)
    return sessions_of(near).orderBy(*newest_first()), info
