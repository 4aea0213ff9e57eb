"""Current against previous period, from one scan of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.measures import change_rate
from usageloom.model import COMPARE_ROWS, Scope
from usageloom.operators.rollup import usage_rollup
from usageloom.plans.periods import CURRENT, PREVIOUS, PeriodPair, split_periods


def _counted(scope: Scope) -> list[str]:
    names = [name for _, name in scope.counted]
    return ["total_tokens", "usage_event_count", "call_count", "sessions", *names]


def _period_totals(
    events: DataFrame, pair: PeriodPair, scope: Scope, zone: str, totals: DataFrame | None
) -> DataFrame:
    return usage_rollup(split_periods(events, pair, zone), ["period"], scope) if totals is None else totals


def compare_summary(
    spark: SparkSession, events: DataFrame, pair: PeriodPair, scope: Scope, zone: str, totals: DataFrame | None = None
) -> DataFrame:
    """One row per period with its label and dates; a period without events is zero."""
    labels = spark.createDataFrame(
        [
            (CURRENT, pair.labels[0], pair.current.start, pair.current.end),
            (PREVIOUS, pair.labels[1], pair.previous.start, pair.previous.end),
        ],
        "period string, label string, start_date date, end_date date",
    )
    metrics = _counted(scope)
    totals = _period_totals(events, pair, scope, zone, totals).select("period", *metrics)
    zero = F.lit(0).cast("bigint")
    return labels.join(totals, "period", "left").select(
        *labels.columns, *[F.coalesce(m, zero).alias(m) for m in metrics]
    )


def compare_delta(
    events: DataFrame, pair: PeriodPair, scope: Scope, zone: str, totals: DataFrame | None = None
) -> DataFrame:
    """Current less previous for each metric, with the rate of the token change."""
    metrics = _counted(scope)
    totals = _period_totals(events, pair, scope, zone, totals)
    zero = F.lit(0).cast("bigint")

    def of(period: str, metric: str):
        return F.coalesce(F.max(F.when(F.col("period") == period, F.col(metric))), zero)

    wide = totals.agg(
        *[(of(CURRENT, m) - of(PREVIOUS, m)).alias(m) for m in metrics],
        of(PREVIOUS, "total_tokens").alias("_previous"),
    )
    return wide.select(
        "total_tokens",
        change_rate(F.col("total_tokens"), F.col("_previous")).alias("total_tokens_rate"),
        *metrics[1:],
    )


def _token_sums(period_events: DataFrame, keys: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return period_events.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("period") == p, F.col("total_tokens"))), zero).alias(
                f"{p}_total_tokens"
            )
            for p in (CURRENT, PREVIOUS)
        ],
        *also,
    )


def _with_delta(sums: DataFrame) -> DataFrame:
    delta = F.col("current_total_tokens") - F.col("previous_total_tokens")
    return sums.withColumn("delta_total_tokens", delta).withColumn(
        "delta_total_tokens_rate",
        change_rate(F.col("delta_total_tokens"), F.col("previous_total_tokens")),
    )


def compare_by(
    events: DataFrame, pair: PeriodPair, keys: Sequence[str], zone: str, rows: int = COMPARE_ROWS
) -> DataFrame:
    """The largest token changes per key, up or down; ties go by key."""
    return largest_changes(split_periods(events, pair, zone), keys, rows)


def largest_changes(
    period_rows: DataFrame, keys: Sequence[str], rows: int = COMPARE_ROWS, also: Sequence[Column] = ()
) -> DataFrame:
    """As ``compare_by``, from events or buckets that carry their period."""
    deltas = _with_delta(_token_sums(period_rows, keys, also))
    return deltas.orderBy(F.abs("delta_total_tokens").desc(), *keys).limit(rows)


def day_index(pair: PeriodPair) -> Column:
    """Place of a row's date in its period, from 0."""
    start = F.when(F.col("period") == CURRENT, F.lit(pair.current.start)).otherwise(
        F.lit(pair.previous.start)
    )
    return F.datediff("local_date", start).cast("bigint")


def compare_daily(
    spark: SparkSession, events: DataFrame, pair: PeriodPair, zone: str, indexed: DataFrame | None = None
) -> DataFrame:
    """Day i of the current period beside day i of the previous one.

    Days the previous period lacks count zero, but keep their date. ``indexed``
    gives rows or buckets that carry period and day_index already.
    """
    if indexed is None:
        indexed = split_periods(events, pair, zone).withColumn("day_index", day_index(pair))
    spine = spark.range(pair.current.days).withColumnRenamed("id", "day_index")
    step = F.col("day_index").cast("int")
    zero = F.lit(0).cast("bigint")
    joined = spine.join(_token_sums(indexed, ["day_index"]), "day_index", "left").select(
        "day_index",
        F.date_add(F.lit(pair.current.start), step).alias("current_date"),
        F.date_add(F.lit(pair.previous.start), step).alias("previous_date"),
        F.coalesce("current_total_tokens", zero).alias("current_total_tokens"),
        F.coalesce("previous_total_tokens", zero).alias("previous_total_tokens"),
    )
    return (
        _with_delta(joined)
        .withColumn("label", F.date_format("current_date", "E"))
        .select(
            "day_index",
            "label",
            "current_date",
            "previous_date",
            "current_total_tokens",
            "previous_total_tokens",
            "delta_total_tokens",
            "delta_total_tokens_rate",
        )
        .orderBy("day_index")
    )
