"""The fact table: Parquet by month of the event's local date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.instants import local_date
from usageloom.model import TOKENS


def in_range(df: DataFrame, start: date, end: date, zone: str) -> DataFrame:
    """Events whose date in ``zone`` lies in the closed range; sets ``local_date``.

    The bounds on ``event_ts``, a day wide on both sides, reach the Parquet scan.
    Of a table by months only the range's months are listed, with the same slack.
    """
    if "year_month" in df.columns:
        df = df.filter(F.col("year_month").between(_month_number(start - timedelta(days=1)), _month_number(end + timedelta(days=1))))
    low, high = start - timedelta(days=1), end + timedelta(days=2)
    return (
        df.filter(f"event_ts >= timestamp '{low}' AND event_ts < timestamp '{high}'")
        .withColumn("local_date", local_date(F.col("event_ts"), zone))
        .filter(f"local_date BETWEEN date '{start}' AND date '{end}'")
    )


def year_month(day: Column) -> Column:
    """Partition value such as 202401; an integer, so that it is read back unchanged."""
    return F.year(day) * 100 + F.month(day)


def _month_number(day: date) -> int:
    return day.year * 100 + day.month


def write_usage_by_month(events: DataFrame, path: str, mode: str = "append") -> None:
    """Route events to their month; every task writes its own rows, without a shuffle."""
    (
        events.withColumn("year_month", year_month(F.col("local_date")))
        .sortWithinPartitions("year_month", "event_ts")
        .write.mode(mode)
        .partitionBy("year_month")
        .parquet(path)
    )


def read_usage(
    spark: SparkSession, path: str, start: date, end: date, zone: str
) -> DataFrame:
    """Month-pruned read; a day of slack covers zones other than the writer's."""
    return in_range(spark.read.parquet(path), start, end, zone)


def read_uploads(uploads: DataFrame, start: date, end: date) -> DataFrame:
    return uploads.filter(F.col("upload_date").between(F.lit(start), F.lit(end)))


def match(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; a blank value keeps everything."""
    for column, value in wanted.items():
        if value and value.strip():
            df = df.filter(F.col(column) == value)
    return df


def export_events(events: DataFrame, start: date, end: date, zone: str) -> DataFrame:
    """Key, session, model, time and counters of a range, by time."""
    return (
        in_range(events, start, end, zone)
        .select("event_key", "session_id", "model", "event_ts", *TOKENS)
        .orderBy("event_ts", "event_key")
    )


def ordered_events(events: DataFrame) -> DataFrame:
    return events.orderBy("event_ts", "event_key")
