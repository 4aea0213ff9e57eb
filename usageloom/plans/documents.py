"""Reports as JSON: one bounded head document, and one JSON row per list item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.instants import offset_text
from usageloom.functions.measures import fixed
from usageloom.model import LOCAL, TEAM, Scope
from usageloom.operators.grains import Grains, Keep, Section
from usageloom.plans import local_reports, team_reports
from usageloom.plans.compare import compare_daily, compare_delta, compare_summary, day_index, largest_changes
from usageloom.plans.periods import PeriodPair, Range, period_of
from usageloom.session import scratch_dir, settings, stage
from usageloom.sources.facts import in_range, match

# Decimal places of printed ratios and averages.
SIX_PLACES = ("cache_hit_rate", "reasoning_ratio", "total_tokens_rate", "delta_total_tokens_rate")
TWO_PLACES = ("avg_tokens_per_session", "avg_tokens_per_call")
_RENAMED = {"local_date": "date"}


def document_fields(
    report: DataFrame, zone: str, renamed: Mapping[str, str] | None = None
) -> list[Column]:
    """Columns as they are printed: fixed decimals, local times, former names kept."""
    names = {**_RENAMED, **(renamed or {})}
    fields: list[Column] = []
    for field in report.schema:
        column = F.col(field.name)
        name = names.get(field.name, field.name)
        kind = field.dataType.typeName()
        if field.name in SIX_PLACES:
            # A decimal keeps its six printed places in JSON.
            column = fixed(column, 6).cast("decimal(38,6)")
        elif field.name in TWO_PLACES:
            column = fixed(column, 2).cast("decimal(38,2)")
        elif kind == "timestamp":
            column = F.coalesce(offset_text(column, zone), F.lit(""))
        elif kind == "date":
            column = column.cast("string")
        fields.append(column.alias(name))
        if field.name == "net_input_tokens":
            fields.append(column.alias("non_cached_input_tokens"))
        if field.name == "net_total_tokens":
            fields.append(column.alias("net_tokens"))
    return fields


#: Sections of a local report that print their sessions under another name.
LOCAL_NAMES = {"daily": {"sessions": "session_count"}, "models": {"sessions": "session_count"}}


def report_rows(
    sections: Mapping[str, DataFrame], zone: str, renamed: Mapping[str, Mapping[str, str]] | None = None
) -> DataFrame:
    """(section, item) rows of any number of reports, whatever their length.

    This is the whole report: a list without a size bound, such as sessions, is
    never gathered into one value.
    """
    parts = [
        report.select(
            F.lit(name).alias("section"),
            F.to_json(F.struct(*document_fields(report, zone, (renamed or {}).get(name)))).alias("item"),
        )
        for name, report in sections.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _by_rank(a: Column, b: Column) -> Column:
    return F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0)


def report_document(
    summary: DataFrame,
    span: Range,
    zone: str,
    lists: Mapping[str, tuple[DataFrame, Sequence[str]]],
) -> DataFrame:
    """One JSON document: range, summary and lists bounded by their definition.

    ``lists`` maps a name to a report and its order columns (a leading ``-``
    sorts down). Meant for days of a range, tools and top-k lists; use
    ``report_rows`` for the rest.
    """
    gathered = []
    for name, (report, order) in lists.items():
        rank = [
            (-F.col(c[1:]) if c.startswith("-") else F.col(c)).alias(f"k{i}")
            for i, c in enumerate(order)
        ]
        items = report.select(
            F.struct(*rank).alias("_k"), F.struct(*document_fields(report, zone)).alias("_i")
        ).agg(F.array_sort(F.collect_list(F.struct("_k", "_i")), _by_rank).alias("_all"))
        listed = items.select(F.transform("_all", lambda x: x["_i"]))
        gathered.append(listed.scalar().alias(name))
    bounds = F.struct(
        F.lit(span.kind).alias("kind"),
        F.lit(str(span.start)).alias("start_date"),
        F.lit(str(span.end)).alias("end_date"),
        F.lit(span.days).alias("days"),
        F.lit(zone).alias("timezone"),
    )
    head = F.struct(*document_fields(summary, zone)).alias("summary")
    return summary.select(F.to_json(F.struct(bounds.alias("range"), head, *gathered)).alias("document"))


_CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _kept(spark: SparkSession) -> Keep:
    """Stage the tables of one report run; results by section, in a folder each.

    Shuffle files of a job go when its table is written, so those of one job do not
    lie beside those of the next.
    """

    def keep(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
        with settings(spark, _CLEANED):
            if by is None:
                return stage(spark, df, purpose)
            path = scratch_dir(spark, purpose)
            df.write.partitionBy(by).parquet(path)
            return spark.read.schema(df.schema).parquet(path)

    return keep


#: Rows of the report's range, and rows of its comparison.
_IN_SPAN, _COMPARED = "in_span", "period IS NOT NULL"


def report_base(every: DataFrame, span: Range, pair: PeriodPair, zone: str) -> DataFrame:
    """Events of the range and of both periods, each with what it takes part in; one scan with bounds."""
    days = (span.start, span.end, *[d for p in (pair.previous, pair.current) for d in (p.start, p.end)])
    return (
        in_range(every, min(days), max(days), zone)
        .withColumn("in_span", F.col("local_date").between(F.lit(span.start), F.lit(span.end)))
        .withColumn("period", period_of(F.col("local_date"), pair))
        .where("in_span OR period IS NOT NULL")
        .withColumn("day_index", F.when(F.col("period").isNotNull(), day_index(pair)))
    )


def _report_grains(
    spark: SparkSession,
    every: DataFrame,
    span: Range,
    pair: PeriodPair,
    zone: str,
    scope: Scope,
    sections: Sequence[Section],
    compared: Mapping[str, tuple[str, ...]],
    also: Mapping[str, tuple[str, str]] | None = None,
) -> Grains:
    """Sections over the range and comparisons over the periods, from one scan of the events."""
    whole = [replace(s, where=_IN_SPAN) for s in sections]
    whole += [Section(name, ("period", *keys), _COMPARED) for name, keys in compared.items()]
    base = report_base(every, span, pair, zone)
    return Grains(base, scope, tuple(whole), ("in_span", "period"), also or {}, _kept(spark))


#: Comparisons of a report, and their keys besides the period.
_COMPARISONS = {"compare": (), "compare_daily": ("day_index",), "compare_models": ("model",), "compare_tools": ("tool",)}


def _compared(spark: SparkSession, grains: Grains, pair: PeriodPair, scope: Scope, zone: str) -> dict[str, DataFrame]:
    totals = grains.rollup("compare")
    return {
        "comparison_summary": compare_summary(spark, grains.events, pair, scope, zone, totals),
        "comparison_delta": compare_delta(grains.events, pair, scope, zone, totals),
        "comparison_daily": compare_daily(spark, grains.events, pair, zone, grains.rollup("compare_daily")),
        "comparison_models": largest_changes(grains.rollup("compare_models"), ["model"]),
        "comparison_tools": largest_changes(grains.rollup("compare_tools"), ["tool"]),
    }


def local_report(spark: SparkSession, every: DataFrame, span: Range, pair: PeriodPair, zone: str) -> DataFrame:
    """The whole local report as rows, from one scan of ``every``: the range and both periods."""
    own = (local_reports.SUMMARY, local_reports.DAILY, local_reports.MODELS, local_reports.TOOLS, local_reports.SESSIONS)
    grains = _report_grains(spark, every, span, pair, zone, LOCAL, own, _COMPARISONS)
    events = grains.events
    sections = {
        "summary": local_reports.local_summary(events, grains),
        "daily": local_reports.local_daily(spark, events, span, grains),
        "models": local_reports.local_models(events, grains),
        "tools": local_reports.local_tools(events, grains),
        "sessions": local_reports.local_sessions(events, grains),
        **_compared(spark, grains, pair, LOCAL, zone),
    }
    return report_rows(sections, zone, LOCAL_NAMES)


def team_report(
    spark: SparkSession,
    every: DataFrame,
    registry: DataFrame,
    uploads: DataFrame,
    span: Range,
    pair: PeriodPair,
    as_of: datetime,
    zone: str,
    team: str | None = None,
    user: str | None = None,
    tool: str | None = None,
) -> DataFrame:
    """The whole team report as rows: all twelve sections, the comparison in its parts.

    ``team``, ``user`` and ``tool`` keep what they name, in every section; a
    blank one keeps everything. Uploads have no tool.
    """
    t = team_reports
    own = (t.SUMMARY, t.TEAMS, t.USERS, t.DEVICES, t.MODELS, t.TOOLS, t.TEAM_MODELS, t.DAILY, t.USER_DAILY)
    every = match(every, team_id=team, user_id=user, tool=tool)
    uploads = match(uploads, team_id=team, user_id=user)
    also = {**t.FIRST_DEVICE, **t.FIRST_USER, **t.LAST_TEAM}
    compared = {**_COMPARISONS, "compare_users": ("team_id", "user_id")}
    grains = _report_grains(spark, every, span, pair, zone, TEAM, own, compared, also)
    events = grains.events
    sections = {
        "summary": t.team_summary(events, grains),
        "teams": t.team_rollup(events, uploads, grains),
        "users": t.team_users(events, registry, grains),
        "devices": t.team_devices(events, registry, grains),
        "models": t.team_models(events, grains),
        "tools": t.team_tools(events, grains),
        "team_models": t.team_model_detail(events, registry, grains),
        "daily": t.team_daily(spark, events, span, grains),
        "user_daily": t.team_user_daily(events, registry, grains),
        "upload_health": t.upload_health(uploads, as_of),
        "uploads": t.upload_list(uploads),
        **_compared(spark, grains, pair, TEAM, zone),
        "comparison_users": t.team_compare_users(events, registry, pair, zone, grains),
    }
    return report_rows(sections, zone)
