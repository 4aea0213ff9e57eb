"""Reports of one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.model import LOCAL, MAX_SESSION_PAGE, TOKENS
from usageloom.operators.grains import MAP_VALUES, Grains, Section
from usageloom.operators.rollup import METRICS, usage_rollup
from usageloom.plans.compare import compare_by, compare_daily, compare_delta, compare_summary
from usageloom.plans.periods import PeriodPair, Range, day_spine

_ZERO_LONGS = (
    *TOKENS,
    "net_input_tokens",
    "net_total_tokens",
    "usage_event_count",
    "call_count",
    "sessions",
    "active_seconds",
)
_ZERO_DOUBLES = (
    "cache_hit_rate",
    "reasoning_ratio",
    "avg_tokens_per_session",
    "avg_tokens_per_call",
)


def zero_filled(spine: DataFrame, rollup: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per date of the spine; dates without events are zero."""
    zero = {**dict.fromkeys((*_ZERO_LONGS, *more), "0L"), **dict.fromkeys(_ZERO_DOUBLES, "0.0D")}
    return (
        spine.join(rollup, "local_date", "left")
        .selectExpr(
            "local_date",
            *[f"coalesce({c}, {zero[c]}) AS {c}" if c in zero else c for c in (*METRICS, *more)],
        )
        .orderBy("local_date")
    )


def by_total(rollup: DataFrame, *keys: str) -> DataFrame:
    return rollup.orderBy(F.col("total_tokens").desc(), *keys)


HISTOGRAMS = ("source_kind", "source_quality")
#: Sections of a local report over its range, and their conditions.
SUMMARY = Section("summary", facets=HISTOGRAMS)
DAILY = Section("daily", ("local_date",))
MODELS = Section("models", ("model",), facets=("tool",))
TOOLS = Section("tools", ("tool",), facets=HISTOGRAMS)
SESSIONS = Section("sessions", ("session_id",), facets=("tool", "model"))


def _alone(events: DataFrame, section: Section) -> Grains:
    return Grains(events, LOCAL, (section,))


def with_maps(grains: Grains, name: str) -> DataFrame:
    """A section's rollup with source_kind and source_quality maps."""
    keys = list(grains.section(name).keys)
    counts = grains.value_maps(name, HISTOGRAMS)
    if keys:
        return grains.with_values(name, counts)
    none = F.expr("map('unknown', 0L)")
    whole = [F.when(F.size(c) > 0, F.col(c)).otherwise(none) for c in HISTOGRAMS]
    return grains.rollup(name).select(
        "*", *[counts.select(w).scalar().alias(c) for w, c in zip(whole, HISTOGRAMS)]
    )


def beyond_maps(grains: Grains, name: str, most: int = MAP_VALUES) -> DataFrame:
    """Counts of the source values that a section's maps have no room for."""
    return grains.values_beyond(name, HISTOGRAMS, most)


def local_summary(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    return with_maps(grains or _alone(events, SUMMARY), "summary")


def local_daily(spark: SparkSession, events: DataFrame, span: Range, grains: Grains | None = None) -> DataFrame:
    rollup = grains.rollup("daily") if grains else usage_rollup(events, ["local_date"], LOCAL)
    return zero_filled(day_spine(spark, span), rollup)


def local_models(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    grains = grains or _alone(events, MODELS)
    tools = grains.value_lists("models", {"tool": "tools"})
    return by_total(grains.with_values("models", tools), "model")


def local_tools(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    return by_total(with_maps(grains or _alone(events, TOOLS), "tools"), "tool")


def session_buckets(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    grains = grains or _alone(events, SESSIONS)
    lists = grains.value_lists("sessions", {"tool": "tools", "model": "models"})
    return grains.with_values("sessions", lists)


def newest_first() -> list[Column]:
    return [F.col("started_at").desc(), F.col("session_id").asc()]


def local_sessions(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    return session_buckets(events, grains).orderBy(*newest_first())


def page_info(sessions: DataFrame, page: int, page_size: int) -> DataFrame:
    """One row: page, page size, sessions and pages; refuses pages that cannot be."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_SESSION_PAGE:
        raise ValueError("page_size must be between 1 and 10")
    total = sessions.agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        F.lit(page).cast("bigint").alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("bigint").alias("total_pages"),
    )


def local_sessions_page(
    events: DataFrame, page: int = 1, page_size: int = 10
) -> tuple[DataFrame, DataFrame]:
    """One page of sessions, newest first, and the one-row page information.

    The page is found from session starts alone, and read first: its ids, ten at
    most, then reach the scan. A stored session summary (``plans/sessions.py``)
    reads no events at all.
    """
    info = page_info(events.select("session_id").distinct(), page, page_size)
    starts = events.groupBy("session_id").agg(F.min("event_ts").alias("started_at"))
    chosen = starts.orderBy(*newest_first()).offset((page - 1) * page_size).limit(page_size)
    ids = [r.session_id for r in chosen.select("session_id").collect()]
    own = events.where(F.col("session_id").isin([i for i in ids if i is not None]) | (F.lit(None in ids) & F.col("session_id").isNull()))
    return session_buckets(own).orderBy(*newest_first()), info


def local_compare_summary(
    spark: SparkSession, events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_summary(spark, events, pair, LOCAL, zone)


def local_compare_delta(
    events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_delta(events, pair, LOCAL, zone)


def local_compare_daily(
    spark: SparkSession, events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_daily(spark, events, pair, zone)


def local_compare_models(
    events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_by(events, pair, ["model"], zone)


def local_compare_tools(
    events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_by(events, pair, ["tool"], zone)
