"""Reports of teams, and the health of their uploads."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usageloom.functions.texts import is_blank
from usageloom.model import (
    DEVICE,
    OVERVIEW_ROWS,
    RANKED_MODEL_ROWS,
    RECENT_UPLOADS_PER_DEVICE,
    STALE_GAP_SECONDS,
    TEAM,
    TOKENS,
    UPLOAD_LIST_ROWS,
    WARNING_GAP_SECONDS,
)
from usageloom.operators.registry import device_names
from usageloom.operators.grains import Grains, Section
from usageloom.plans.compare import compare_by, compare_daily, compare_delta, compare_summary, largest_changes
from usageloom.plans.local_reports import HISTOGRAMS, by_total, with_maps, zero_filled
from usageloom.plans.periods import CURRENT, PeriodPair, Range, day_spine, split_periods


def _name_users(rollup: DataFrame, registry: DataFrame) -> DataFrame:
    """Display name of a user: the name of the first device they used in the bucket.

    Names are looked up for buckets, not for events, so the facts are never
    joined with the registry.
    """
    names = device_names(registry).withColumnRenamed("device_id", "_first_device")
    named = rollup.join(names, ["team_id", "user_id", "_first_device"], "left")
    shown = F.when(is_blank(F.col("device_name")), F.col("user_id")).otherwise(F.col("device_name"))
    return named.withColumn("display_name", shown).drop("_first_device", "device_name")


SUMMARY = Section("summary", facets=HISTOGRAMS)
TEAMS = Section("teams", ("team_id",))
USERS = Section("users", ("team_id", "user_id"))
DEVICES = Section("devices", ("team_id", "device_id"))
MODELS = Section("models", ("model",))
TOOLS = Section("tools", ("tool",), facets=HISTOGRAMS)
DAILY = Section("daily", ("local_date",))
USER_DAILY = Section("user_daily", ("local_date", "team_id", "user_id"))
TEAM_MODELS = Section("team_models", ("local_date", "team_id", "user_id", "tool", "model"))
COMPARE_USERS = Section("compare_users", ("period", "team_id", "user_id"))

#: What buckets are named by: device and user of the session that started first, team of the one that ended last.
FIRST_DEVICE = {"_first_device": ("first", "device_id")}
FIRST_USER = {"_first_user": ("first", "user_id")}
LAST_TEAM = {"_last_team": ("last", "team_id")}


def _alone(events: DataFrame, section: Section, also: Mapping[str, tuple[str, str]] | None = None) -> Grains:
    return Grains(events, TEAM, (section,), also=also or {})


def _plain(rollup: DataFrame) -> DataFrame:
    """A rollup without the columns that only names are found by."""
    return rollup.drop(*FIRST_DEVICE, *FIRST_USER, *LAST_TEAM)


def team_summary(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    rows = with_maps(grains or _alone(events, SUMMARY, LAST_TEAM), "summary")
    return _plain(rows.withColumn("team_id", F.coalesce("_last_team", F.lit(""))))


def team_rollup(events: DataFrame, uploads: DataFrame, grains: Grains | None = None) -> DataFrame:
    """Teams with tokens, uploads, or both; a team with uploads only is zero."""
    latest = uploads.groupBy("team_id").agg(F.max("upload_time").alias("last_upload_at"))
    joined = _plain((grains or _alone(events, TEAMS)).rollup("teams")).join(latest, "team_id", "full")
    longs = (
        *TOKENS,
        "net_input_tokens",
        "net_total_tokens",
        "usage_event_count",
        "call_count",
        "sessions",
        "active_seconds",
        "users",
        "devices",
    )
    doubles = ("cache_hit_rate", "reasoning_ratio", "avg_tokens_per_session", "avg_tokens_per_call")
    filled = joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in longs},
            **{c: F.coalesce(c, F.lit(0.0)) for c in doubles},
        }
    )
    return by_total(filled, "team_id")


def team_users(events: DataFrame, registry: DataFrame, grains: Grains | None = None) -> DataFrame:
    rollup = (grains or _alone(events, USERS, FIRST_DEVICE)).rollup("users")
    named = _plain(_name_users(rollup, registry)).withColumn("last_seen_at", F.col("ended_at"))
    return by_total(named, *USERS.keys)


def team_devices(events: DataFrame, registry: DataFrame, grains: Grains | None = None) -> DataFrame:
    """Devices with their owner, the first user seen on them."""
    rollup = (grains or _alone(events, DEVICES, FIRST_USER)).rollup("devices")
    named = rollup.withColumn("user_id", F.col("_first_user")).join(device_names(registry), list(DEVICE), "left")
    shown = F.when(is_blank(F.col("device_name")), F.col("device_id")).otherwise(
        F.col("device_name")
    )
    return by_total(
        _plain(named.withColumn("display_name", shown))
        .withColumn("last_seen_at", F.col("ended_at"))
        .drop("device_name"),
        *DEVICES.keys,
    )


def team_models(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    return by_total(_plain((grains or _alone(events, MODELS)).rollup("models")), "model")


def team_tools(events: DataFrame, grains: Grains | None = None) -> DataFrame:
    return by_total(_plain(with_maps(grains or _alone(events, TOOLS), "tools")), "tool")


def _model_detail(events: DataFrame, registry: DataFrame, grains: Grains | None = None) -> DataFrame:
    grains = grains or _alone(events, TEAM_MODELS, FIRST_DEVICE)
    return _plain(_name_users(grains.rollup("team_models"), registry))


def team_model_detail(events: DataFrame, registry: DataFrame, grains: Grains | None = None) -> DataFrame:
    return _model_detail(events, registry, grains).orderBy(
        F.col("local_date").desc(), "team_id", "user_id", "tool", "model"
    )


def team_daily(spark: SparkSession, events: DataFrame, span: Range, grains: Grains | None = None) -> DataFrame:
    rollup = (grains or _alone(events, DAILY)).rollup("daily")
    return zero_filled(day_spine(spark, span), rollup, more=("users", "devices"))


def team_user_daily(events: DataFrame, registry: DataFrame, grains: Grains | None = None) -> DataFrame:
    rollup = (grains or _alone(events, USER_DAILY, FIRST_DEVICE)).rollup("user_daily")
    return _plain(_name_users(rollup, registry)).orderBy("local_date", "user_id", "team_id")


_OUTCOME = ("status", "accepted", "duplicate", "rejected")


def health_status(status: Column, gap_seconds: Column) -> Column:
    return (
        F.when(status != "ok", "error")
        .when(gap_seconds > STALE_GAP_SECONDS, "stale")
        .when(gap_seconds > WARNING_GAP_SECONDS, "warning")
        .otherwise("ok")
    )


def latest_uploads(uploads: DataFrame) -> DataFrame:
    """Newest upload of each device; among equal times the greatest outcome."""
    newest = F.max(F.struct("upload_time", *_OUTCOME))
    return uploads.groupBy(*DEVICE).agg(newest.alias("_u"))


def upload_health(uploads: DataFrame, as_of: datetime) -> DataFrame:
    """State of every device that uploaded, the longest silent one first."""
    now = F.lit(int(as_of.timestamp()))
    gap = F.greatest(F.lit(0).cast("bigint"), now - F.unix_seconds("_u.upload_time"))
    return (
        latest_uploads(uploads)
        .select(
            *DEVICE,
            F.col("_u.upload_time").alias("last_upload_at"),
            gap.alias("upload_gap_seconds"),
            health_status(F.col("_u.status"), gap).alias("health_status"),
            *[F.col(f"_u.{c}").alias(f"latest_{c}") for c in _OUTCOME],
        )
        .orderBy("last_upload_at", "user_id", "device_id")
    )


def recent_uploads(uploads: DataFrame, rows: int = RECENT_UPLOADS_PER_DEVICE) -> DataFrame:
    """Newest uploads per device; each task keeps its best few before the shuffle."""
    newest = Window.partitionBy(*DEVICE).orderBy(*[F.col(c).desc() for c in ("upload_time", *_OUTCOME)])
    return (
        uploads.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= rows)
        .withColumn("position", F.col("position").cast("bigint"))
    )


def upload_list(uploads: DataFrame, rows: int = UPLOAD_LIST_ROWS) -> DataFrame:
    return uploads.orderBy(F.col("upload_time").desc(), *DEVICE, *[F.col(c).desc() for c in _OUTCOME]).limit(rows)


def team_compare_summary(
    spark: SparkSession, events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_summary(spark, events, pair, TEAM, zone)


def team_compare_delta(
    events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_delta(events, pair, TEAM, zone)


def team_compare_daily(
    spark: SparkSession, events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_daily(spark, events, pair, zone)


def team_compare_users(
    events: DataFrame, registry: DataFrame, pair: PeriodPair, zone: str, grains: Grains | None = None
) -> DataFrame:
    """Largest changes per user, named by the current period where it has the user."""
    rows = (grains or _alone(split_periods(events, pair, zone), COMPARE_USERS, FIRST_DEVICE)).rollup("compare_users")
    keys = ["team_id", "user_id"]
    first = F.min_by("_first_device", F.when(F.col("period") == CURRENT, 0).otherwise(1))
    named = _name_users(largest_changes(rows, keys, also=[first.alias("_first_device")]), registry)
    return named.orderBy(F.abs("delta_total_tokens").desc(), *keys)


def team_compare_models(
    events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_by(events, pair, ["model"], zone)


def team_compare_tools(
    events: DataFrame, pair: PeriodPair, zone: str
) -> DataFrame:
    return compare_by(events, pair, ["tool"], zone)


_TEXT_FIELDS = ("team_id", "user_id", "display_name", "tool", "model")


def ranked_team_models(
    events: DataFrame,
    registry: DataFrame,
    field: str = "total_tokens",
    descending: bool = True,
    rows: int = RANKED_MODEL_ROWS,
) -> DataFrame:
    """Model detail by any field, text without regard to case; the top rows."""
    column = F.lower(F.col(field)) if field in _TEXT_FIELDS else F.col(field)
    lead = column.desc() if descending else column.asc()
    return (
        _model_detail(events, registry)
        .orderBy(lead, F.col("local_date").desc(), "tool", "model", "team_id", "user_id")
        .limit(rows)
    )


def overview_top6(ranked_report: DataFrame, rows: int = OVERVIEW_ROWS) -> DataFrame:
    """The first rows of a report that is already in its order."""
    return ranked_report.limit(rows)


def filter_facets(events: DataFrame) -> DataFrame:
    """Distinct teams and tools to choose from, as (facet, value)."""
    facets = F.explode(
        F.array(
            F.struct(F.lit("team").alias("facet"), F.col("team_id").alias("value")),
            F.struct(F.lit("tool").alias("facet"), F.col("tool").alias("value")),
        )
    )
    return (
        events.select("team_id", "tool")
        .distinct()
        .select(facets.alias("f"))
        .select("f.*")
        .filter(~is_blank(F.col("value")))
        .distinct()
        .orderBy("facet", "value")
    )


def has_usage(events: DataFrame) -> DataFrame:
    """Whether a range holds any call or token."""
    any_tokens = F.coalesce(F.sum("total_tokens"), F.lit(0)) > 0
    return events.agg(((F.count(F.lit(1)) > 0) | any_tokens).alias("has_usage"))
