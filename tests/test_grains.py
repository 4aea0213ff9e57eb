"""Reports of many sections read their events once."""

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from test_team import ZONE, row, team_rows
from usageloom.model import LOCAL, TEAM
from usageloom.operators.grains import Grains, Section
from usageloom.operators.rollup import usage_rollup
from usageloom.plans import documents, local_reports, periods, team_reports
from usageloom.sources.facts import in_range

SPAN = periods.resolve_range(date(2026, 5, 17), month="2026-05")
WEEK = periods.resolve_period("week", date(2026, 5, 17))


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """A stored fact: calls with several events, sessions over tools, models and days, nulls and blanks."""
    path = str(tmp_path_factory.mktemp("fact") / "events")
    rows = [
        row(
            f"2026-05-{1 + i % 20:02d}T{i * 7 % 24:02d}:{i * 13 % 60:02d}:00", f"k{i}", session=f"s{i % 9}",
            tool=("codex", "claude-code")[i % 2], model=f"m{i % 3}", tokens=(i, i // 3, i % 7, i % 2, i + i % 7), user=f"u{i % 4}",
        )
        for i in range(300)
    ]
    events = team_rows(spark, *rows).withColumns(
        {
            "source_kind": F.when(F.col("input_tokens") % 3 == 0, "local_jsonl").when(F.col("input_tokens") % 3 == 1, ""),
            "source_quality": F.lit("derived"),
        }
    )
    events.unionByName(events.where("input_tokens % 11 = 0").withColumn("event_key", F.concat("event_key", F.lit("b")))).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(
        [("h", "t", "u1", "u1-dev", "One", "active", datetime(2026, 1, 1), None, "p")],
        "token_hash string, team_id string, user_id string, device_id string, display_name string, status string,"
        " created_at timestamp, last_seen_at timestamp, token_preview string",
    )


@pytest.fixture(scope="module")
def uploads(spark):
    return spark.createDataFrame(
        [("t", "u1", "u1-dev", date(2026, 5, 1), datetime(2026, 5, 1), 1, 1, 0, 0, "ok", "")],
        "team_id string, user_id string, device_id string, upload_date date, upload_time timestamp, event_count bigint,"
        " accepted bigint, duplicate bigint, rejected bigint, status string, message string",
    )


def scans(df, path):
    """How often the planned query reads files below a path."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return sum("Scan parquet" in node and path in node for node in plan.split("\n\n"))


def scans_run(df, path):
    """How often the executed query read files below a path; a reused exchange reads nothing."""
    df.collect()
    tree = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan" in line and path in line for line in tree.split("\n"))


def recorded(monkeypatch):
    staged = []
    keep_of = documents._kept

    def kept(spark):
        keep = keep_of(spark)

        def record(df, purpose, by=None):
            staged.append((purpose, df))
            return keep(df, purpose, by)

        return record

    monkeypatch.setattr(documents, "_kept", kept)
    return staged


def test_whole_reports_scan_the_events_once(spark, facts, names, uploads, monkeypatch):
    staged = recorded(monkeypatch)
    every = spark.read.parquet(facts)
    for make in (
        lambda: documents.local_report(spark, every, SPAN, WEEK, ZONE),
        lambda: documents.team_report(spark, every, names, uploads, SPAN, WEEK, datetime(2026, 5, 18), ZONE),
    ):
        report = make()
        assert sorted(p for p, _ in staged) == ["base", "facets", "rollups"]
        assert sum(scans(df, facts) for _, df in staged) == 1
        assert scans(report, facts) == 0
        base = next(df for p, df in staged if p == "base")
        assert "GreaterThanOrEqual(event_ts" in base._jdf.queryExecution().executedPlan().toString()
        # One shuffle by (section, keys, session, half hour) serves all sections.
        rollups = next(df for p, df in staged if p == "rollups")
        assert scans(rollups, "/") == 1
        assert report.count() > 30
        staged.clear()


@pytest.mark.parametrize("name", ["local_models", "local_tools", "local_sessions", "team_tools"])
def test_single_sections_read_their_events_once(spark, facts, name):
    events = in_range(spark.read.parquet(facts), SPAN.start, SPAN.end, ZONE)
    report = getattr(local_reports if name.startswith("local") else team_reports, name)(events)
    assert scans_run(report, facts) == 1


def test_compared_users_are_read_once(spark, facts, names):
    report = team_reports.team_compare_users(spark.read.parquet(facts), names, WEEK, ZONE)
    assert scans(report, facts) == 1


def test_sections_together_equal_one_rollup_each(spark, facts):
    events = in_range(spark.read.parquet(facts), SPAN.start, SPAN.end, ZONE)
    keys = {"all": (), "days": ("local_date",), "teams": ("team_id", "user_id"), "sessions": TEAM.session, "odd": ("model", "tool")}
    sections = tuple(Section(n, k, "true", ("tool",) if n == "days" else ()) for n, k in keys.items())
    grains = Grains(events, TEAM, sections)
    for name, own in keys.items():
        want = usage_rollup(events, list(own), TEAM)
        assert grains.rollup(name).columns == want.columns
        assert sorted(map(str, grains.rollup(name).collect())) == sorted(map(str, want.collect()))


def test_a_report_without_events(spark, facts):
    nothing = in_range(spark.read.parquet(facts).where("false"), SPAN.start, SPAN.end, ZONE)
    grains = Grains(nothing, LOCAL, (local_reports.SUMMARY, local_reports.DAILY))
    zero = local_reports.local_summary(nothing, grains).collect()
    assert len(zero) == 1 and zero[0].sessions == 0 and zero[0].source_kind == {"unknown": 0}
    assert grains.rollup("daily").count() == 0


def test_conditions_part_the_range_from_the_periods(spark, facts):
    base = documents.report_base(spark.read.parquet(facts), SPAN, WEEK, ZONE)
    sections = (Section("in", (), "in_span"), Section("by", ("period",), "period IS NOT NULL"))
    grains = Grains(base, LOCAL, sections, ("in_span", "period"))
    whole = {r.event_key for r in base.where("in_span").collect()}
    assert grains.rollup("in").first().usage_event_count == len(whole)
    both = {r.period: r.usage_event_count for r in grains.rollup("by").collect()}
    want = {r["period"]: r["count"] for r in base.where("period IS NOT NULL").groupBy("period").count().collect()}
    assert both == want and len(want) == 2


def test_team_report_filters_reach_every_section(spark, facts, names, uploads):
    every = spark.read.parquet(facts)
    make = lambda **by: documents.team_report(spark, every, names, uploads, SPAN, WEEK, datetime(2026, 5, 18), ZONE, **by)
    own = every.where("user_id = 'u1' AND tool = 'claude-code'")
    kept = sorted(map(str, make(user="u1", tool="claude-code", team=" ").collect()))
    want = documents.team_report(spark, own, names, uploads.where("user_id = 'u1'"), SPAN, WEEK, datetime(2026, 5, 18), ZONE)
    assert kept == sorted(map(str, want.collect()))
    assert not [r for r in make(user="u2").where("section = 'uploads'").collect()]


def test_a_store_by_months_lists_only_the_months_of_a_report(spark, facts, tmp_path):
    from usageloom.sources.facts import write_usage_by_month

    events = spark.read.parquet(facts)
    older = events.withColumn("local_date", F.add_months("local_date", -3)).withColumn("event_ts", F.col("event_ts") - F.expr("INTERVAL 90 DAYS"))
    write_usage_by_month(events.unionByName(older), f"{tmp_path}/months")
    stored = spark.read.parquet(f"{tmp_path}/months")
    assert len({r.year_month for r in stored.select("year_month").distinct().collect()}) > 1
    ranged = in_range(stored, SPAN.start, SPAN.end, ZONE)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "year_month" in plan.split("PartitionFilters")[1].split("]")[0]
    assert ranged.count() == in_range(events, SPAN.start, SPAN.end, ZONE).count()


def test_maps_hold_the_heaviest_values_and_rows_the_others(spark, facts):
    """A free text with a value per event: maps stay short, and no count is lost."""
    texts = F.when(F.col("input_tokens") % 2 == 0, "often").otherwise(F.concat(F.lit("v"), F.col("input_tokens").cast("string")))
    events = spark.read.parquet(facts).withColumn("source_kind", texts)
    grains = Grains(in_range(events, SPAN.start, SPAN.end, ZONE), LOCAL, (local_reports.TOOLS,))
    full = {r.tool: r.source_kind for r in grains.value_maps("tools", local_reports.HISTOGRAMS).collect()}
    heavy = {r.tool: r.source_kind for r in grains.value_maps("tools", local_reports.HISTOGRAMS, most=3).collect()}
    beyond = local_reports.beyond_maps(grains, "tools", most=3).collect()
    assert local_reports.beyond_maps(grains, "tools").count() == 0
    for tool, counts in full.items():
        order = sorted(counts, key=lambda v: (-counts[v], v))
        assert heavy[tool] == {v: counts[v] for v in order[:3]}
        assert {r.value: r.n for r in beyond if r.tool == tool and r.dimension == "source_kind"} == {v: counts[v] for v in order[3:]}
    assert max(map(len, full.values())) > 100
    plan = grains.value_maps("tools", local_reports.HISTOGRAMS, most=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def odd_events(spark):
    """Nulls in every session column, users with several devices, equal starts, sessions over midnight and half hours."""
    rows = [
        row(
            f"2026-05-{1 + i % 3:02d}T{(23, 0, 15)[i % 3]:02d}:{i * 17 % 60:02d}:00", f"k{i}", session=f"s{i % 11}", tool=("codex", "claude-code")[i % 2],
            model=f"m{i % 3}", tokens=(i, i // 3, i % 7, i % 2, i + i % 7), user=f"u{i % 4}",
        )
        for i in range(240)
    ]
    n = F.col("input_tokens")
    return team_rows(spark, *rows).withColumns(
        {
            "team_id": F.when(n % 10 != 0, F.concat(F.lit("t"), (n % 2).cast("string"))),
            "user_id": F.when(n % 13 != 0, F.col("user_id")),
            "device_id": F.when(n % 17 != 0, F.concat(F.lit("d"), (n % 5).cast("string"))),
            "session_id": F.when(n % 19 != 0, F.col("session_id")),
            "model": F.when(n % 23 != 0, F.col("model")),
            "source_kind": F.when(n % 3 == 0, "a"),
        }
    )


def test_sections_together_count_and_name_buckets_as_alone(spark):
    once = odd_events(spark)
    events = once.unionByName(once.where("input_tokens % 6 = 0").withColumns({"event_key": F.lit("again"), "source_kind": F.lit("b")}))
    events = events.withColumn("early", F.col("local_date") < "2026-05-03")
    also = {**team_reports.FIRST_DEVICE, **team_reports.FIRST_USER, **team_reports.LAST_TEAM}
    sections = (
        Section("summary", facets=("source_kind",)), Section("early", ("team_id", "user_id"), "early"), Section("early_models", ("model",), "early"),
        *[Section(f"by{i}", k) for i, k in enumerate(
            [("team_id", "user_id"), ("team_id", "device_id"), ("model",), (*TEAM.session, "tool"), ("local_date", "team_id", "user_id", "tool", "model")]
        )],
    )
    grains = Grains(events, TEAM, sections, ("early",), also, documents._kept(spark))
    for s in sections:
        alone = Grains(events.where(s.where), TEAM, (Section(s.name, s.keys),), also=also).rollup(s.name)
        together = grains.rollup(s.name)
        assert [(f.name, f.dataType) for f in together.schema] == [(f.name, f.dataType) for f in alone.schema]
        assert sorted(map(str, together.collect())) == sorted(map(str, alone.collect())), s.name


@pytest.mark.parametrize("report", ["local", "team"])
def test_half_hours_are_dealt_to_sections_after_their_last_shuffle(spark, facts, names, uploads, monkeypatch, report):
    """Dealt before, every section's rows of every event would lie in shuffle files, twice."""
    staged = recorded(monkeypatch)
    every = spark.read.parquet(facts)
    if report == "local":
        documents.local_report(spark, every, SPAN, WEEK, ZONE)
    else:
        documents.team_report(spark, every, names, uploads, SPAN, WEEK, datetime(2026, 5, 18), ZONE)
    rollups = next(df for p, df in staged if p == "rollups")
    plan = rollups._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [line.split("(")[0] for line in plan[next(i for i, line in enumerate(plan) if " Window " in line):]]
    kinds = [kind for line in below for kind in ("Generate", "Exchange") if f" {kind} " in f"{line} "]
    assert kinds == ["Generate", "Exchange", "Exchange"]


def shuffle_files(spark):
    every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in every.split("\n") if "/shuffle_" in f}


def test_shuffle_files_of_a_staged_job_go_with_it(spark, facts):
    keep = documents._kept(spark)
    counts = spark.read.parquet(facts).groupBy("model", "tool").count()
    want = sorted(map(str, counts.collect()))
    before = shuffle_files(spark)
    kept = [keep(counts, "counts"), keep(counts, "counts", "tool")]
    until = time.time() + 30
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)  # executors drop them shortly after the job
    assert not shuffle_files(spark) - before
    for df in kept:
        assert sorted(map(str, df.select(*counts.columns).collect())) == want


def test_sessions_of_a_device_are_summed_together_unless_it_has_many_calls(spark):
    hot = [row(f"2026-05-01T{i % 24:02d}:00:00", f"h{i}", session=f"h{i % 40}", user="hot", tokens=(i, 0, 1, 0, i + 1)) for i in range(160)]
    rest = [row(f"2026-05-02T{i % 24:02d}:00:00", f"r{i}", session=f"r{i}", user=f"u{i % 10}", tokens=(i, 0, 1, 0, i + 1)) for i in range(30)]
    sections = (Section("users", ("team_id", "user_id", "device_id")), Section("models", ("model",)))
    grains = Grains(team_rows(spark, *hot, *rest), TEAM, sections, keep=documents._kept(spark))
    by = grains.base.withColumn("place", grains._place(["team_id", "user_id", "device_id", "model"], 8)).groupBy("user_id")
    places = {r.user_id: (r.n, r.sessions) for r in by.agg(F.count_distinct("place").alias("n"), F.count_distinct("session_id").alias("sessions")).collect()}
    assert places.pop("hot") == (40, 40)
    assert len(places) == 10 and set(places.values()) == {(1, 3)}
    assert {r.user_id: r.sessions for r in grains.rollup("users").collect()} == {"hot": 40, **dict.fromkeys(places, 3)}
