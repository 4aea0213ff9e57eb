"""Golden cases of team ingest, metrics, periods, comparisons and the outbox."""

import os
import json
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from usageloom.model import LOCAL, TEAM, TOKENS
from usageloom.operators import outbox
from usageloom.operators.gate import too_many_chars
from usageloom.operators.idempotent import first_per_key, insert_new_events
from usageloom.operators.rank import ranked
from usageloom.operators.registry import device_names, register_tokens, touch_last_seen, upsert_registry
from usageloom.operators.rollup import usage_rollup
from usageloom.operators.team_ingest import ingest_team_batch, ledger_rows
from usageloom.plans import documents, jobs, local_reports, periods, team_reports
from usageloom.plans.jobs import TEAM_SCHEMA, Tables, read_runs, run_team_ingest
from usageloom.streaming.ingest import stream_ingest_envelopes

ZONE = "Asia/Shanghai"
AT = datetime(2026, 5, 1, 9)


def event(key, ts, gross, output=0, tool="codex", session="s", model="m", **more):
    base = {
        "event_key": key, "tool": tool, "session_id": session, "model": model, "timestamp": ts,
        "input_tokens": gross, "cached_input_tokens": 0, "output_tokens": output,
        "reasoning_output_tokens": 0, "total_tokens": gross + output,
    }
    base.update(more)
    return {k: v for k, v in base.items() if v is not None}


def envelopes(spark, *rows):
    """(id, token, body dict or text)"""
    data = [
        (i, token, AT + timedelta(minutes=n), body if isinstance(body, str) else json.dumps(body))
        for n, (i, token, body) in enumerate(rows)
    ]
    return spark.createDataFrame(data, "envelope_id string, token string, uploaded_at timestamp, body string")


@pytest.fixture
def registry(spark):
    tokens = spark.createDataFrame(
        [("token-one", "t", "u", "dev", "Laptop", "active"), ("token-off", "t", "u2", "dev2", "", "revoked")],
        "token string, team_id string, user_id string, device_id string, display_name string, status string",
    )
    return register_tokens(tokens).withColumn("created_at", F.lit(AT)).withColumn(
        "last_seen_at", F.lit(None).cast("timestamp")
    )


def empty_store(spark):
    return spark.createDataFrame([], TEAM_SCHEMA)


def results(run):
    return {r.envelope_id: r for r in run.results.collect()}


def test_accept_then_duplicate(spark, registry, tmp_path):
    body = {
        "client_user_id": "u",
        "events": [
            event("a", "2026-05-01T08:00:00Z", 100, 30, cached_input_tokens=20),
            event("b", "2026-05-01T08:00:01Z", 70, 20),
            event("c", "2026-05-01T16:30:00Z", 10),
        ],
    }
    tables = Tables(str(tmp_path / "store"))
    first = run_team_ingest(spark, envelopes(spark, ("e1", "token-one", body)), registry, tables, ZONE, 0)
    assert first.select("accepted", "duplicate", "rejected").first() == (3, 0, 0)
    again = run_team_ingest(spark, envelopes(spark, ("e2", "token-one", body)), registry, tables, ZONE, 1)
    assert again.select("accepted", "duplicate", "rejected").first() == (0, 3, 0)
    repeated = run_team_ingest(spark, envelopes(spark, ("e1", "token-one", body)), registry, tables, ZONE, 0)
    assert repeated.first().accepted == 3
    stored = read_runs(spark, tables.events, TEAM_SCHEMA)
    assert stored.count() == 3
    total = usage_rollup(stored, [], TEAM).first()
    assert (total.total_tokens, total.active_seconds, total.call_count) == (230, 1, 3)
    assert round(total.avg_tokens_per_call, 2) == 76.67
    assert {r.year_month for r in stored.select("year_month").distinct().collect()} == {202605}
    assert spark.read.parquet(tables.uploads).count() == 2


def test_guards_in_order(spark, registry):
    ok = {"events": [event("a", "2026-05-01T08:00:00Z", 1)]}
    many = {"events": [event(f"k{i}", "2026-05-01T08:00:00Z", 1) for i in range(501)]}
    run = ingest_team_batch(
        envelopes(
            spark,
            ("long", "nobody", "x" * 1_048_577), ("wide", "nobody", "😀" * 600_000),
            ("missing", "", ok), ("unknown", "nobody", ok), ("off", "token-off", ok),
            ("user", "token-one", {**ok, "client_user_id": "other"}),
            ("device", "token-one", {**ok, "client_device_id": "other"}),
            ("array", "token-one", {"events": {"a": 1}}), ("json", "token-one", "not json"),
            ("many", "token-one", many), ("fine", "token-one", ok), ("empty", "token-one", {"events": []}),
        ),
        registry, empty_store(spark), ZONE,
    )
    codes = {k: r.code for k, r in results(run).items()}
    assert codes == {
        "long": "payload_too_large", "wide": "payload_too_large", "missing": "unauthorized",
        "unknown": "unauthorized", "off": "forbidden", "user": "identity_conflict",
        "device": "identity_conflict", "array": "invalid_payload", "json": "invalid_payload",
        "many": "payload_too_large", "fine": "ok", "empty": "ok",
    }
    ledger = ledger_rows(run.results, ZONE)
    assert ledger.count() == 2
    failed = ledger_rows(run.results, ZONE, storage_error="storage_error").collect()
    assert {(r.status, r.accepted) for r in failed} == {("error", 0)}


def test_size_counts_utf16_units(spark):
    texts = spark.createDataFrame([("😀" * 524_288,), ("😀" * 524_289,), ("x" * 1_048_576,)], "body string")
    assert [r[0] for r in texts.select(too_many_chars(F.col("body"))).collect()] == [False, True, False]


def test_rejected_events(spark, registry):
    ts = "2026-05-01T08:00:00Z"
    body = {
        "events": [
            event("a", ts, 1, tool="other"), event("b", ts, 1, prompt="x"), event(" ", ts, 1),
            event("d", ts, 1, session=""), event("e", "", 1), event("f", "2026-05-01", 1),
            event("g", ts, 0), event("h", ts, 10**25), event("i", ts, 1, model="prompt"),
            event("j", ts, 100, 10, reasoning_output_tokens=3, total_tokens=None, model=None),
            event("j", ts, 100, 10),
        ]
    }
    run = ingest_team_batch(envelopes(spark, ("e", "token-one", body)), registry, empty_store(spark), ZONE)
    row = results(run)["e"]
    assert (row.event_count, row.accepted, row.duplicate, row.rejected) == (11, 1, 1, 9)
    (stored,) = run.new_events.collect()
    assert (stored.total_tokens, stored.model, stored.source_kind, stored.source_quality) == (
        113, "unknown", "unknown", "unknown",
    )
    assert (stored.team_id, stored.user_id, stored.device_id) == ("t", "u", "dev")
    assert "event_text" not in run.new_events.columns


def team_rows(spark, *rows):
    """(user, device, session, tool, model, ts, key, gross, cached, out, reasoning, total)"""
    data = [
        ("t", u, dv, s, tool, m, datetime.fromisoformat(ts), key, *tokens)
        for u, dv, s, tool, m, ts, key, *tokens in rows
    ]
    names = ", ".join(f"{t} bigint" for t in TOKENS)
    return spark.createDataFrame(
        data,
        "team_id string, user_id string, device_id string, session_id string, tool string, "
        f"model string, event_ts timestamp, event_key string, {names}",
    ).withColumn("local_date", F.to_date(F.from_utc_timestamp("event_ts", ZONE)))


def row(ts, key, session="s", tool="codex", model="m", tokens=(1, 0, 0, 0, 1), user="u"):
    return (user, f"{user}-dev", session, tool, model, ts, key, *tokens)


def test_totals(spark):
    events = team_rows(
        spark,
        row("2026-05-01T08:00:00", "a", tokens=(16, 5, 7, 2, 25)),
        row("2026-05-01T08:00:00", "b", tokens=(100, 90, 10, 1, 111)),
    )
    total = usage_rollup(events, [], TEAM).first()
    assert (total.input_tokens, total.cached_input_tokens, total.net_input_tokens) == (116, 95, 21)
    assert total.net_total_tokens == 41
    assert total.cache_hit_rate == pytest.approx(0.8189655172)


def test_cached_above_gross_clamps(spark):
    total = usage_rollup(team_rows(spark, row("2026-05-01T08:00:00", "a", tokens=(5, 9, 0, 0, 5))), [], TEAM).first()
    assert (total.net_input_tokens, total.cache_hit_rate, total.reasoning_ratio) == (0, 1.0, 0.0)


def test_no_events_is_a_zero_row(spark):
    total = usage_rollup(team_rows(spark, row("2026-05-01T08:00:00", "a")).filter("false"), [], TEAM).first()
    assert (total.total_tokens, total.sessions, total.cache_hit_rate) == (0, 0, 0.0)


def test_same_call_under_two_keys(spark):
    total = usage_rollup(
        team_rows(spark, row("2026-05-01T08:00:00", "a"), row("2026-05-01T08:00:00", "b")), [], TEAM
    ).first()
    assert (total.usage_event_count, total.call_count, total.total_tokens) == (2, 1, 2)


@pytest.mark.parametrize(
    ("second", "active"),
    [("2026-05-01T08:30:00", 1800), ("2026-05-01T08:30:00.999999", 1800), ("2026-05-01T08:30:01", 0), ("2026-05-09T08:00:00", 0)],
)
def test_gap_limit(spark, second, active):
    events = team_rows(spark, row("2026-05-01T08:00:00", "a"), row(second, "b"))
    assert usage_rollup(events, [], TEAM).first().active_seconds == active


def test_active_time_is_per_bucket(spark):
    """A0 B10 A20 B30: each model spans twenty seconds, the session thirty."""
    events = team_rows(
        spark,
        *[row(f"2026-05-01T08:00:{s:02d}", str(s), model=m) for s, m in ((0, "A"), (10, "B"), (20, "A"), (30, "B"))],
    )
    assert usage_rollup(events, [], TEAM).first().active_seconds == 30
    assert {r.active_seconds for r in usage_rollup(events, ["model"], TEAM).collect()} == {20}


def test_active_time_against_brute_force(spark):
    rng = random.Random(7)
    times = [rng.randrange(0, 86_400 * 2) for _ in range(300)] + [rng.randrange(0, 7_200) for _ in range(100)]
    start = datetime(2026, 5, 1)
    events = team_rows(
        spark, *[row((start + timedelta(seconds=t)).isoformat(), str(i)) for i, t in enumerate(times)]
    )
    ordered = sorted(times)
    expected = sum(b - a for a, b in zip(ordered, ordered[1:]) if b - a <= 1800)
    assert usage_rollup(events, [], TEAM).first().active_seconds == expected


def test_hot_session_never_meets_in_one_task(spark):
    """A session with every row: no window runs over its events."""
    events = team_rows(spark, row("2026-05-01T08:00:00", "a"))
    plan = usage_rollup(events, ["tool"], TEAM)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window"):]
    assert window.index("HashAggregate") < window.index("Scan")


def test_periods():
    week = periods.resolve_period("week", date(2026, 5, 21))
    assert (week.current.start, week.current.end) == (date(2026, 5, 18), date(2026, 5, 21))
    assert (week.previous.start, week.previous.end) == (date(2026, 5, 11), date(2026, 5, 14))
    month = periods.resolve_period("month", date(2026, 3, 31))
    assert (month.current.start, month.current.end) == (date(2026, 3, 1), date(2026, 3, 31))
    assert (month.previous.start, month.previous.end) == (date(2026, 2, 1), date(2026, 2, 28))
    for wrong in ({"days": 5}, {"days": "x"}, {"month": "2026-5"}):
        with pytest.raises(ValueError):
            periods.resolve_range(date(2026, 5, 1), **wrong)
    with pytest.raises(ValueError):
        periods.resolve_period("year", date(2026, 5, 1))
    assert periods.resolve_range(date(2026, 5, 9), days=7, month="current").days == 31


def test_week_comparison(spark):
    events = team_rows(
        spark,
        row("2026-05-19T02:00:00", "a", tokens=(1000, 0, 0, 0, 1000)),
        row("2026-05-20T02:00:00", "b", tokens=(2000, 0, 0, 0, 2000), user="v"),
        row("2026-05-12T02:00:00", "c", tokens=(400, 0, 0, 0, 400)),
        row("2026-05-13T02:00:00", "d", tokens=(600, 0, 0, 0, 600)),
        row("2026-05-15T02:00:00", "late", tokens=(999, 0, 0, 0, 999)),
    )
    pair = periods.resolve_period("week", date(2026, 5, 21))
    both = {r.period: r for r in team_reports.team_compare_summary(spark, events, pair, ZONE).collect()}
    assert (both["current"].total_tokens, both["previous"].total_tokens) == (3000, 1000)
    assert (both["current"].users, both["current"].label) == (2, "This Week")
    delta = team_reports.team_compare_delta(events, pair, ZONE).first()
    assert (delta.total_tokens, delta.total_tokens_rate, delta.users) == (2000, 2.0, 1)
    days = team_reports.team_compare_daily(spark, events, pair, ZONE).collect()
    assert [(d.label, d.delta_total_tokens) for d in days] == [
        ("Mon", 0), ("Tue", 600), ("Wed", 1400), ("Thu", 0),
    ]
    nothing = team_reports.team_compare_summary(spark, events.filter("false"), pair, ZONE).collect()
    assert [r.total_tokens for r in nothing] == [0, 0]


def test_session_pages(spark):
    start = datetime(2026, 5, 1, 8)
    events = team_rows(
        spark,
        *[row((start + timedelta(minutes=7 * i)).isoformat(), str(i), session=f"s{i:02d}") for i in range(55)],
    )
    rows, info = local_reports.local_sessions_page(events, page=1)
    assert [r.session_id for r in rows.collect()] == [f"s{i:02d}" for i in range(54, 44, -1)]
    assert info.first() == (1, 10, 55, 6)
    last, _ = local_reports.local_sessions_page(events, page=6)
    assert last.count() == 5
    assert [r.session_id for r in last.collect()] == [f"s{i:02d}" for i in range(4, -1, -1)]
    for wrong in ({"page": 0}, {"page_size": 11}):
        with pytest.raises(ValueError):
            local_reports.local_sessions_page(events, **wrong)


def test_invariants(spark):
    events = team_rows(
        spark,
        *[row(f"2026-05-{1 + i % 9:02d}T{i % 24:02d}:15:00", str(i), tool=("codex", "claude-code")[i % 2], tokens=(i, 0, i, 0, 2 * i)) for i in range(80)],
    )
    total = usage_rollup(events, [], LOCAL).first()
    daily = local_reports.local_daily(spark, events, periods.Range("days", date(2026, 5, 1), date(2026, 5, 12)))
    assert daily.count() == 12
    assert daily.agg(F.sum("total_tokens")).first()[0] == total.total_tokens
    assert total.call_count <= total.usage_event_count
    for bucket in usage_rollup(events, ["tool"], LOCAL).collect():
        assert bucket.active_seconds <= total.active_seconds


def test_two_keys_inserted_three_times(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "event_key string, n int")
    nothing = batch.filter("false")
    assert sorted(map(tuple, insert_new_events(batch, nothing, ["event_key"], ["n"]).collect())) == [("a", 1), ("b", 2)]
    assert insert_new_events(batch, batch, ["event_key"], ["n"]).count() == 0


def test_hot_key_shrinks_before_the_shuffle(spark):
    """Copies of a key are cut to one row per task: an aggregate, and no window."""
    rows = spark.range(1000).select(F.lit("hot").alias("event_key"), "id")
    plan = first_per_key(rows, ["event_key"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_ranks_match_a_global_order(spark):
    start = datetime(2026, 5, 1)
    rows = spark.createDataFrame(
        [("d1" if i % 3 else "d2", start + timedelta(seconds=(i * 7919) % 4000), f"k{i}") for i in range(500)],
        "device string, ts timestamp, key string",
    )
    order = [F.col("ts").asc(), F.col("key").asc()]
    got = {r.key: r.rank for r in ranked(rows, order, within=["device"]).collect()}
    by_device = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.key)):
        by_device.setdefault(r.device, []).append(r.key)
    assert got == {k: i + 1 for keys in by_device.values() for i, k in enumerate(keys)}


def test_rows_of_one_instant_are_ranked_by_many_tasks(spark):
    rows = spark.range(4000).select(F.lit(datetime(2026, 5, 1)).alias("ts"), F.col("id").cast("string").alias("key"))
    placed = ranked(rows, [F.col("ts").asc(), F.col("key").asc()])
    got = {r.key: r.rank for r in placed.collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))}
    order = [F.col("ts").asc(), F.col("key").asc()]
    dealt = rows.repartitionByRange(8, *order).groupBy(F.spark_partition_id().alias("p")).count()
    assert dealt.count() > 4


def cursor_case(spark):
    at = lambda s: datetime(2026, 5, 1, 8, 0, s)
    events = spark.createDataFrame(
        [("u", "d", at(0), "a"), ("u", "d", at(0), "b"), ("u", "d", at(5), "c"), ("u", "d", at(30), "late"), ("v", "e", at(1), "x"), ("v", "e", datetime(2026, 1, 1), "old")],
        "user_id string, device_id string, event_ts timestamp, event_key string",
    ).withColumn("local_date", F.to_date("event_ts"))
    cursors = spark.createDataFrame(
        [("u", "d", at(0), "a")], "user_id string, device_id string, cursor_ts timestamp, cursor_key string"
    )
    return events, cursors


def test_cursor_ties_lookback_and_cutoff(spark):
    events, cursors = cursor_case(spark)
    pending = outbox.pending_after_cursor(events, cursors, "2026-05-01 08:00:10", date(2026, 5, 1))
    assert sorted(r.event_key for r in pending.collect()) == ["b", "c", "x"]
    # A cursor older than the lookback window still finds everything after it.
    later = outbox.pending_after_cursor(events, cursors, "2026-09-01 00:00:00", date(2026, 9, 1))
    assert sorted(r.event_key for r in later.collect()) == ["b", "c", "late"]


@pytest.mark.parametrize(("ok", "rejected", "key"), [(True, 0, "c"), (False, 0, "a"), (True, 1, "a")])
def test_cursor_moves_only_on_success(spark, ok, rejected, key):
    events, cursors = cursor_case(spark)
    pending = outbox.pending_after_cursor(events, cursors, "2026-05-01 08:00:10", date(2026, 5, 1)).filter("user_id = 'u'")
    outcome = spark.createDataFrame([("u", "d", ok, rejected)], "user_id string, device_id string, ok boolean, rejected int")
    assert outbox.advance_cursor(cursors, pending, outcome).first().cursor_key == key
    empty = outbox.advance_cursor(cursors, pending.filter("false"), outcome)
    assert empty.first().cursor_key == "a"


def test_outbox_round_trips_through_ingest(spark, registry):
    events = team_rows(
        spark, *[row(f"2026-05-01T08:{i % 60:02d}:00", f"k{i:03d}", tokens=(i + 1, 0, 0, 0, i + 1)) for i in range(45)]
    ).withColumns({"device_id": F.lit("dev"), "source_kind": F.lit("local_jsonl"), "source_quality": F.lit("")})
    idle = spark.createDataFrame([("u", "dev"), ("w", "idle")], "user_id string, device_id string")
    sent = outbox.upload_outbox(events, idle, batch=20)
    counts = sorted((r.device_id, r.batch_no, r.event_count) for r in sent.collect())
    assert counts == [("dev", 0, 20), ("dev", 1, 20), ("dev", 2, 5), ("idle", 0, 0)]
    bodies = [(f"e{r.batch_no}", "token-one", r.body) for r in sent.filter("device_id = 'dev'").collect()]
    assert '"source_quality"' not in bodies[0][2]
    run = ingest_team_batch(envelopes(spark, *bodies), registry, empty_store(spark), ZONE)
    assert sum(r.accepted for r in run.results.collect()) == 45


def test_registry(spark, registry):
    preview = {r.token_preview for r in registry.collect()}
    assert preview == {"t****e", "t****f"}
    long = register_tokens(spark.createDataFrame([("abcdef-middle-wxyz",), (" ",)], "token string"))
    assert {r.token_preview for r in long.collect()} == {"abcdef****wxyz", "unrecoverable"}
    change = registry.filter("status = 'active'").withColumn("status", F.lit("disabled")).withColumn(
        "created_at", F.lit(datetime(2030, 1, 1))
    )
    merged = {r.device_id: r for r in upsert_registry(registry, change).collect()}
    assert merged["dev"].status == "disabled" and merged["dev"].created_at == AT
    doubled = registry.unionByName(registry.withColumn("token_hash", F.lit("0")))
    assert device_names(doubled).count() == 2


def test_upload_health(spark):
    now = datetime(2026, 5, 1, 12)
    ages = (("ok", 1800), ("ok", 1801), ("ok", 7200), ("ok", 7201), ("error", 5))
    uploads = spark.createDataFrame(
        [("t", "u", f"d{i}", now - timedelta(seconds=a), s, 1, 0, 0) for i, (s, a) in enumerate(ages)],
        "team_id string, user_id string, device_id string, upload_time timestamp, status string, accepted bigint, duplicate bigint, rejected bigint",
    )
    health = team_reports.upload_health(uploads, now.replace(tzinfo=timezone.utc))
    status = {r.device_id: r.health_status for r in health.collect()}
    assert status == {"d0": "ok", "d1": "warning", "d2": "warning", "d3": "stale", "d4": "error"}
    assert health.first().device_id == "d3"


def test_documents(spark):
    events = team_rows(
        spark, row("2026-05-01T16:30:00.5", "a", tokens=(10, 5, 7, 1, 18)), row("2026-05-01T16:30:02", "b", tool="claude-code")
    ).withColumns({"source_kind": F.lit(""), "source_quality": F.lit("derived")})
    span = periods.Range("days", date(2026, 5, 1), date(2026, 5, 3))
    text = documents.report_document(
        local_reports.local_summary(events), span, ZONE,
        {
            "daily": (local_reports.local_daily(spark, events, span), ["local_date"]),
            "tools": (local_reports.local_tools(events), ["-total_tokens", "tool"]),
        },
    ).first().document
    parsed = json.loads(text)
    assert '"reasoning_ratio":0.142857' in text
    assert parsed["range"] == {"kind": "days", "start_date": "2026-05-01", "end_date": "2026-05-03", "days": 3, "timezone": ZONE}
    assert parsed["summary"]["started_at"] == "2026-05-02T00:30:00.5+08:00"
    assert parsed["summary"]["source_kind"] == {"unknown": 2}
    assert [d["date"] for d in parsed["daily"]] == ["2026-05-01", "2026-05-02", "2026-05-03"]
    assert [t["tool"] for t in parsed["tools"]] == ["codex", "claude-code"]
    rows = documents.report_rows({"sessions": local_reports.local_sessions(events)}, ZONE).collect()
    assert json.loads(rows[0]["item"])["non_cached_input_tokens"] == 6


def test_comparisons_push_their_bounds_to_the_scan(spark, tmp_path):
    pair = periods.resolve_period("week", date(2024, 1, 17))
    spark.createDataFrame([], TEAM_SCHEMA).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    registry = spark.createDataFrame([], "token_hash string, team_id string, user_id string, device_id string, display_name string")
    plans = [
        local_reports.local_compare_summary(spark, fact, pair, ZONE),
        local_reports.local_compare_delta(fact, pair, ZONE),
        local_reports.local_compare_daily(spark, fact, pair, ZONE),
        local_reports.local_compare_models(fact, pair, ZONE),
        local_reports.local_compare_tools(fact, pair, ZONE),
        team_reports.team_compare_summary(spark, fact, pair, ZONE),
        team_reports.team_compare_delta(fact, pair, ZONE),
        team_reports.team_compare_daily(spark, fact, pair, ZONE),
        team_reports.team_compare_users(fact, registry, pair, ZONE),
        team_reports.team_compare_models(fact, pair, ZONE),
        team_reports.team_compare_tools(fact, pair, ZONE),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in text.splitlines() if "FileScan parquet" in line]
        assert scans and all("GreaterThanOrEqual(event_ts" in x and "LessThan(event_ts" in x for x in scans)


def test_a_retry_in_one_batch_is_counted_once(spark, registry):
    body = {"client_user_id": "u", "events": [event("a", "2026-05-01T08:00:00Z", 5)]}
    twice = envelopes(spark, ("e1", "token-one", body), ("e1", "token-one", body))
    run = ingest_team_batch(twice, registry, empty_store(spark), ZONE)
    rows = sorted((r.event_count, r.accepted, r.duplicate) for r in run.results.collect())
    assert rows == [(1, 0, 1), (1, 1, 0)]


def test_a_failed_run_leaves_a_ledger_row_and_can_be_repeated(spark, registry, tmp_path, monkeypatch):
    body = {"client_user_id": "u", "events": [event("a", "2026-05-01T08:00:00Z", 5)]}
    tables = Tables(str(tmp_path / "store"))
    sent = envelopes(spark, ("e1", "token-one", body))
    with monkeypatch.context() as patch:
        patch.setattr(jobs.Attempt, "write_events", lambda self, events: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_team_ingest(spark, sent, registry, tables, ZONE, 7)
    failed = spark.read.parquet(tables.uploads).collect()
    assert [(r.status, r.event_count, r.accepted) for r in failed] == [("error", 1, 0)]
    assert read_runs(spark, tables.events, TEAM_SCHEMA).count() == 0
    assert run_team_ingest(spark, sent, registry, tables, ZONE, 7).first().accepted == 1
    assert read_runs(spark, tables.events, TEAM_SCHEMA).count() == 1


def test_a_stream_on_a_new_checkpoint_keeps_earlier_batches(spark, registry, tmp_path):
    tables, drop = Tables(str(tmp_path / "store")), str(tmp_path / "drop")
    registry.write.parquet(str(tmp_path / "registry"))
    for n in (1, 2):
        body = {"client_user_id": "u", "events": [event(f"k{n}", "2026-05-01T08:00:00Z", 5)]}
        envelopes(spark, (f"e{n}", "token-one", body)).write.mode("append").parquet(drop)
        stream_ingest_envelopes(
            spark, drop, str(tmp_path / "registry"), tables, ZONE, str(tmp_path / f"checkpoint{n}")
        ).awaitTermination()
        assert read_runs(spark, tables.events, TEAM_SCHEMA).count() == n


def test_half_hours_before_1970_are_aligned(spark):
    rows = spark.sql(
        """SELECT 't' AS team_id, 'u' AS user_id, 'd' AS device_id, 'codex' AS tool, 's' AS session_id, 'm' AS model,
        CAST(ts AS timestamp) AS event_ts, 1L AS input_tokens, 0L AS cached_input_tokens, 0L AS output_tokens,
        0L AS reasoning_output_tokens, 1L AS total_tokens, 'a' AS source_kind, 'b' AS source_quality
        FROM VALUES ('1969-12-31 23:31:00'), ('1970-01-01 00:20:00') AS v(ts)"""
    )
    assert usage_rollup(rows, [], TEAM).first().active_seconds == 0


def test_last_seen_never_goes_back(spark):
    registry = spark.sql("SELECT 'h' AS token_hash, timestamp'2026-05-02 00:00:00' AS last_seen_at")
    seen = spark.sql("SELECT 'h' AS token_hash, timestamp'2026-05-01 00:00:00' AS uploaded_at")
    assert touch_last_seen(registry, seen).first().last_seen_at.day == 2


def test_equal_upload_times_have_a_defined_order(spark):
    rows = spark.sql(
        """SELECT 't' AS team_id, 'u' AS user_id, 'd' AS device_id, timestamp'2026-05-01 00:00:00' AS upload_time, *
        FROM VALUES ('ok', 2L, 0L, 0L), ('error', 0L, 0L, 0L), ('ok', 1L, 0L, 0L) AS v(status, accepted, duplicate, rejected)"""
    )
    for order in (rows, rows.orderBy("accepted"), rows.orderBy(F.col("accepted").desc())):
        assert team_reports.latest_uploads(order.coalesce(1)).first()._u.accepted == 2
        assert [r.accepted for r in team_reports.recent_uploads(order).orderBy("position").collect()] == [2, 1, 0]


def test_ranks_keep_rows_of_null_groups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "n int, g string")
    got = sorted(map(tuple, ranked(rows, [F.col("n").asc()], within=["g"]).select("n", "rank").collect()))
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_outbox_keeps_events_of_null_devices(spark):
    events = team_rows(spark, *[row(f"2026-05-01T08:00:{i:02d}", f"k{i}") for i in range(5)]).withColumns(
        {
            "device_id": F.when(F.col("event_key") < "k3", F.lit("dev")),
            "source_kind": F.lit(""), "source_quality": F.lit(""),
        }
    )
    devices = spark.createDataFrame([("u", "dev"), ("u", None), ("v", None)], "user_id string, device_id string")
    sent = outbox.upload_outbox(events, devices, batch=2)
    counts = sorted((r.user_id, r.device_id or "", r.batch_no, r.event_count) for r in sent.collect())
    assert counts == [("u", "", 0, 2), ("u", "dev", 0, 2), ("u", "dev", 1, 1), ("v", "", 0, 0)]
    cursors = spark.createDataFrame(
        [("u", None, datetime(2026, 5, 1, 8, 0, 3), "k3")], "user_id string, device_id string, cursor_ts timestamp, cursor_key string"
    )
    pending = outbox.pending_after_cursor(events, cursors, "2026-06-01 00:00:00", date(2026, 5, 2))
    assert sorted(r.event_key for r in pending.collect()) == ["k0", "k1", "k2", "k4"]
    done = spark.createDataFrame([("u", None, True, 0)], "user_id string, device_id string, ok boolean, rejected int")
    moved = outbox.advance_cursor(cursors, pending.where("device_id IS NULL"), done).collect()
    assert [(r.user_id, r.device_id, r.cursor_key) for r in moved] == [("u", None, "k4")]


def test_entry_works_without_a_library_of_the_text_operators(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.modules["xxhash"] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = entry.queries()
assert "local_tools" in names and "op4_simhash" not in names and "pipeline" not in names
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
