"""The metric layer: one function computes every bucket of every report.

Stages, each shrinking its rows on the map side before it shuffles:

1. one row per distinct call, with the number of its events;
2. one row per session and half hour: sums, calls, first and last second;
3. one row per session;
4. one row per bucket.

Active time needs no list of timestamps. Inside an aligned half hour every gap
is shorter than the limit, so the active time is last less first second. Between
neighbouring non-empty half hours one gap remains, found by a lag over rows that
are at most 48 per session and day. A session of any size therefore costs no
task more than its number of half hours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageloom.functions.texts import or_unknown
from usageloom.model import ACTIVE_GAP_SECONDS, TOKENS, Scope

METRICS = (
    *TOKENS,
    "net_input_tokens",
    "net_total_tokens",
    "cache_hit_rate",
    "reasoning_ratio",
    "usage_event_count",
    "call_count",
    "sessions",
    "active_seconds",
    "avg_tokens_per_session",
    "avg_tokens_per_call",
    "started_at",
    "ended_at",
)

#: Metrics that add up over sessions.
ADDED = (*TOKENS, "net_input_tokens", "usage_event_count", "call_count")


def _names(*groups: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(name for group in groups for name in group))


def call_grain(events: DataFrame, keys: Sequence[str], scope: Scope) -> DataFrame:
    """One row per distinct call; ``usage_event_count`` is how many events it had.

    Every key of a report follows from the call itself (its session, tool,
    model or time), so this table serves all reports of a range.
    """
    return events.groupBy(*_names(keys, scope.call)).agg(
        F.count(F.lit(1)).alias("usage_event_count")
    )


#: The aligned half hour of a call, as wide as the longest counted gap.
SLOT = f"CAST(floor(unix_seconds(event_ts) / {ACTIVE_GAP_SECONDS}) AS bigint)"


def half_hours(calls: DataFrame, keys: Sequence[str], scope: Scope) -> DataFrame:
    """One row per session and aligned half hour; calls may carry theirs as ``_slot``."""
    slot = F.col("_slot") if "_slot" in calls.columns else F.expr(SLOT).alias("_slot")
    return calls.groupBy(*_names(keys, scope.session), slot).agg(
        *[F.expr(f"sum({t} * usage_event_count) AS _{t}") for t in TOKENS],
        F.expr(
            "sum(greatest(0, input_tokens - cached_input_tokens) * usage_event_count)"
            " AS _net_input_tokens"
        ),
        F.expr("sum(usage_event_count) AS _usage_event_count"),
        F.expr("count(*) AS _call_count"),
        F.expr("min(event_ts) AS started_at"),
        F.expr("max(event_ts) AS ended_at"),
    )


def session_grain(slots: DataFrame, keys: Sequence[str], scope: Scope) -> DataFrame:
    """One row per session of each bucket, its active seconds included."""
    group = _names(keys, scope.session)
    along = Window.partitionBy(*group).orderBy("_slot")
    before = F.lag("ended_at").over(along).alias("_before")
    gap = "unix_seconds(started_at) - unix_seconds(_before)"
    return (
        slots.select("*", before)
        .groupBy(*group)
        .agg(
            *[F.expr(f"sum(_{c}) AS _{c}") for c in ADDED],
            F.expr(
                "sum(unix_seconds(ended_at) - unix_seconds(started_at)"
                f" + CASE WHEN {gap} <= {ACTIVE_GAP_SECONDS} THEN {gap} ELSE 0 END) AS _active"
            ),
            F.expr("min(started_at) AS started_at"),
            F.expr("max(ended_at) AS ended_at"),
        )
    )


def usage_rollup(
    events: DataFrame,
    keys: Sequence[str],
    scope: Scope,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """All metrics per ``keys``.

    ``also`` adds aggregates over session rows, which carry the keys, the
    session columns, started_at and ended_at.
    """
    keys = list(keys)
    also = also or {}
    sessions = session_grain(half_hours(call_grain(events, keys, scope), keys, scope), keys, scope)
    sums = sessions.groupBy(*keys).agg(
        *[F.expr(f"coalesce(sum(_{c}), 0L) AS {c}") for c in ADDED],
        F.expr("count(*) AS sessions"),
        F.expr("coalesce(sum(_active), 0L) AS active_seconds"),
        F.expr("min(started_at) AS started_at"),
        F.expr("max(ended_at) AS ended_at"),
        *[F.count_distinct(c).alias(name) for c, name in scope.counted],
        *[column.alias(name) for name, column in also.items()],
    )
    return with_ratios(sums, keys, [name for _, name in scope.counted], list(also))


# How metrics follow from sums; try_divide is null where there is nothing to divide by.
_DERIVED = {
    "net_total_tokens": "net_input_tokens + output_tokens + reasoning_output_tokens",
    "cache_hit_rate": "least(1.0D, coalesce(try_divide(cached_input_tokens, input_tokens), 0.0D))",
    "reasoning_ratio": "coalesce(try_divide(reasoning_output_tokens, output_tokens), 0.0D)",
    "avg_tokens_per_session": "coalesce(try_divide(total_tokens, sessions), 0.0D)",
    "avg_tokens_per_call": "coalesce(try_divide(total_tokens, call_count), 0.0D)",
}


def with_ratios(sums: DataFrame, keys: Sequence[str], *more: Sequence[str]) -> DataFrame:
    """Add derived metrics and fix the column order."""
    return sums.selectExpr(
        *[
            f"{_DERIVED[c]} AS {c}" if c in _DERIVED else f"`{c}`"
            for c in _names(keys, METRICS, *more)
        ]
    )


def value_counts(events: DataFrame, keys: Sequence[str], dimension: str) -> DataFrame:
    """Histogram in long form: (keys, value, count), blank values as unknown."""
    return events.groupBy(*keys, or_unknown(F.col(dimension)).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
