"""Report ranges and period pairs as plain dates; the clock is a parameter."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.sources.facts import in_range

# Allowed day counts and period names with their labels.
DAY_COUNTS = (1, 7, 30)
PERIOD_LABELS = {
    "day": ("Today", "Yesterday"),
    "week": ("This Week", "Previous Week"),
    "month": ("This Month", "Previous Month"),
}

CURRENT, PREVIOUS = "current", "previous"


@dataclass(frozen=True)
class Range:
    kind: str
    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


@dataclass(frozen=True)
class PeriodPair:
    period: str
    current: Range
    previous: Range

    @property
    def labels(self) -> tuple[str, str]:
        return PERIOD_LABELS[self.period]


def _whole_month(year: int, month: int) -> Range:
    last = calendar.monthrange(year, month)[1]
    return Range("month", date(year, month, 1), date(year, month, last))


def resolve_range(as_of: date, days: str | int | None = None, month: str | None = None) -> Range:
    """A month, or the last 1, 7 or 30 days up to ``as_of``; a month wins over days."""
    if month and month.strip():
        if month == "current":
            return _whole_month(as_of.year, as_of.month)
        year, _, number = month.partition("-")
        if len(year) != 4 or len(number) != 2:
            raise ValueError("month must be YYYY-MM or current")
        return _whole_month(int(year), int(number))
    count = 7 if days is None or str(days).strip() == "" else int(days)
    if count not in DAY_COUNTS:
        raise ValueError("days must be one of 1, 7, or 30")
    return Range("days", as_of - timedelta(days=count - 1), as_of)


def resolve_period(period: str, as_of: date) -> PeriodPair:
    """The period up to ``as_of`` and the equally long start of the one before."""
    if period == "day":
        before = as_of - timedelta(days=1)
        return PeriodPair(period, Range(period, as_of, as_of), Range(period, before, before))
    if period == "week":
        monday = as_of - timedelta(days=as_of.weekday())
        week = timedelta(days=7)
        return PeriodPair(
            period, Range(period, monday, as_of), Range(period, monday - week, as_of - week)
        )
    if period == "month":
        first = as_of.replace(day=1)
        last_before = first - timedelta(days=1)
        capped = last_before.replace(day=min(as_of.day, last_before.day))
        return PeriodPair(
            period,
            Range(period, first, as_of),
            Range(period, last_before.replace(day=1), capped),
        )
    raise ValueError("period must be one of day, week, or month")


def period_of(day: Column, pair: PeriodPair) -> Column:
    """current, previous or null; current is tested first."""
    return F.when(day.between(F.lit(pair.current.start), F.lit(pair.current.end)), CURRENT).when(
        day.between(F.lit(pair.previous.start), F.lit(pair.previous.end)), PREVIOUS
    )


def split_periods(events: DataFrame, pair: PeriodPair, zone: str) -> DataFrame:
    """One scan for both periods: keep their events and say which one each is in.

    Dates are those of the query's zone. The bounds on ``event_ts`` from the
    start of the previous to the end of the current period reach the scan.
    """
    start = min(pair.previous.start, pair.current.start)
    end = max(pair.previous.end, pair.current.end)
    return (
        in_range(events, start, end, zone)
        .withColumn("period", period_of(F.col("local_date"), pair))
        .filter(F.col("period").isNotNull())
    )


def day_spine(spark: SparkSession, span: Range) -> DataFrame:
    """Every date of a range, future ones included."""
    return spark.range(span.days).select(
        F.date_add(F.lit(span.start), F.col("id").cast("int")).alias("local_date")
    )
