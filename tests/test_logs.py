"""Golden cases of log decoding and of the local store."""

import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from usageloom.model import LOCAL, TOKENS
from usageloom.operators.decode import (
    all_tool_events,
    carry_context,
    cumulative_to_delta,
    decode_errors,
    dropped_lines,
    message_events,
    snapshot_events,
)
from usageloom.operators.rollup import usage_rollup
from usageloom.plans import jobs
from usageloom.plans.jobs import (
    LOCAL_SCHEMA,
    Tables,
    current_manifest,
    incremental_refresh,
    read_runs,
)
from usageloom.sources.facts import in_range
from usageloom.sources.lines import file_line_counts, session_lines
from usageloom.sources.message_log import (
    message_log_lines,
    message_log_records,
    tag_source,
    usage_telemetry,
)
from usageloom.sources.snapshot_log import snapshot_log_lines, snapshot_log_records

ZONE = "Asia/Shanghai"
NOW = datetime(2026, 6, 1)


def write(folder, name, *lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(
        "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", "utf-8"
    )
    return path


def meta(session):
    return {"type": "session_meta", "payload": {"id": session}}


def context(model):
    return {"type": "turn_context", "payload": {"model": model}}


def token(ts, total, gross=None, cached=0, output=0, reasoning=0):
    counters = (total if gross is None else gross, cached, output, reasoning, total)
    return {
        "timestamp": ts,
        "type": "event_msg",
        "payload": {
            "type": "token_count",
            "info": {
                "total_token_usage": dict(zip(TOKENS, counters)),
                "last_token_usage": dict(zip(TOKENS, (9, 9, 9, 9, 9))),
            },
        },
    }


def snapshot(spark, folder):
    return snapshot_events(snapshot_log_records(snapshot_log_lines(spark, str(folder))), ZONE)


def message(spark, folder, mode="local"):
    return message_events(message_log_records(message_log_lines(spark, str(folder))), ZONE, mode)


@pytest.fixture
def smoke(tmp_path):
    logs = tmp_path / "logs with space+plus"
    write(
        logs, "2026/04/30/rollout-a.jsonl", meta("s-1"), context("gpt-5-smoke"),
        token("2026-04-30T10:00:00Z", 130), token("2026-04-30T10:00:01Z", 220),
    )
    write(
        logs, "2026/04/30/rollout-b.jsonl", meta("s-2"), context("gpt-5-smoke"),
        token("2026-04-30T16:00:02Z", 250),
    )
    write(
        logs, "2026/04/30/rollout-c.jsonl", meta("s-3"), context("gpt-5-smoke"),
        token("2026-04-30T10:00:00Z", 15), token("2026-04-30T10:00:01Z", 30),
    )
    return logs


def test_running_totals_become_events(spark, smoke):
    events = snapshot(spark, smoke).collect()
    assert len(events) == 5
    assert sum(e.total_tokens for e in events) == 500
    assert {e.source_path for e in events} == {str(p) for p in smoke.rglob("*.jsonl")}
    first = next(e for e in events if e.session_id == "s-1" and e.line_number == 3)
    digest = hashlib.sha256(first.source_path.encode()).hexdigest()[:16]
    assert first.event_key == f"codex|s-1|{digest}|3|130|130|0"


def test_refresh_inserts_once_and_replays_changed_files(spark, smoke, tmp_path):
    tables = Tables(str(tmp_path / "store"))
    run = lambda n: incremental_refresh(spark, str(smoke), None, tables, ZONE, n, NOW)
    first = run(1)
    assert (first["files_scanned"], first["files_changed"], first["events_inserted"]) == (3, 3, 5)
    assert run(2)["files_changed"] == 0
    with open(smoke / "2026/04/30/rollout-b.jsonl", "a") as log:
        log.write(json.dumps(token("2026-05-01T01:00:00Z", 260)) + "\n")
    third = run(3)
    assert (third["files_changed"], third["events_inserted"], third["events_skipped"]) == (1, 1, 1)
    events = read_runs(spark, tables.events, LOCAL_SCHEMA)
    may = in_range(events, date(2026, 5, 1), date(2026, 5, 31), ZONE)
    assert usage_rollup(may, [], LOCAL).first().total_tokens == 260
    april = in_range(events, date(2026, 4, 1), date(2026, 4, 30), ZONE)
    model = usage_rollup(april, ["model"], LOCAL).first()
    assert (model.model, model.active_seconds, model.sessions) == ("gpt-5-smoke", 2, 2)
    manifest = {r.path.rsplit("-", 1)[1]: r for r in current_manifest(spark, tables).collect()}
    assert manifest["b.jsonl"].last_line == 4 and manifest["b.jsonl"].status == "active"


def test_repeated_run_replaces_its_output(spark, smoke, tmp_path):
    tables = Tables(str(tmp_path / "store"))
    for _ in range(2):
        incremental_refresh(spark, str(smoke), None, tables, ZONE, 1, NOW)
    assert read_runs(spark, tables.events, LOCAL_SCHEMA).count() == 5


def test_late_model_is_backfilled(spark, tmp_path):
    write(
        tmp_path, "late.jsonl", {"type": "session_meta", "id": "top-level"},
        token("2026-04-30T10:00:00Z", 10), context(""), token("2026-04-30T10:00:01Z", 20),
        context("gpt-known"), token("2026-04-30T10:00:02Z", 30),
    )
    events = snapshot(spark, tmp_path).collect()
    assert {e.model for e in events} == {"gpt-known"}
    assert {e.session_id for e in events} == {"top-level"}


def test_repeats_add_nothing_and_resets_clamp(spark, tmp_path):
    write(
        tmp_path, "stem-name.jsonl",
        token("2026-04-30T10:00:00Z", 100), token("2026-04-30T10:00:01Z", 100),
        token("2026-04-30T10:00:02Z", 150), token("2026-04-30T10:00:03Z", 20),
        token("2026-04-30T10:00:04Z", 25),
    )
    events = sorted(snapshot(spark, tmp_path).collect(), key=lambda e: e.line_number)
    assert [(e.line_number, e.total_tokens) for e in events] == [(1, 100), (3, 50), (5, 5)]
    assert events[0].session_id == "stem-name" and events[0].model == "unknown"


def test_unreadable_lines(spark, tmp_path):
    huge = token("2026-04-30T10:00:00Z", 5)
    huge["payload"]["info"]["total_token_usage"]["output_tokens"] = 10**30
    no_info = token("2026-04-30T10:00:00Z", 5)
    no_info["payload"]["info"] = None
    write(
        tmp_path, "bad.jsonl", "", "not json token_count", token("2026-04-30", 1), huge, no_info,
        token("2026-04-30T18:00:00+08:00", 7),
    )
    records = snapshot_log_records(snapshot_log_lines(spark, str(tmp_path)))
    errors = sorted((r.line, r.message) for r in decode_errors(records).collect())
    assert errors == [
        (3, "parse error: DateTimeParseException"),
        (4, "parse error: NumberFormatException"),
    ]
    (event,) = snapshot_events(records, ZONE).collect()
    assert (event.total_tokens, event.line_number) == (7, 6)
    assert event.event_ts == datetime(2026, 4, 30, 10)


def test_refresh_can_stop_on_errors(spark, tmp_path):
    write(tmp_path / "logs", "bad.jsonl", token("2026-04-30", 1), token("2026-04-30T10:00:00Z", 7))
    logs, tables = str(tmp_path / "logs"), Tables(str(tmp_path / "store"))
    with pytest.raises(RuntimeError):
        incremental_refresh(spark, logs, None, tables, ZONE, 1, NOW, on_error="fail")
    kept = incremental_refresh(spark, logs, None, tables, ZONE, 2, NOW)
    assert (kept["errors"], kept["events_inserted"]) == (1, 1)
    assert current_manifest(spark, tables).first().status == "error"


def usage(**counters):
    return counters


def said(ts, message_id, model="claude-x", session="c-1", **counters):
    body = {"id": message_id, "content": "secret", "usage": counters}
    if model is not None:
        body["model"] = model
    return {"sessionId": session, "timestamp": ts, "message": body}


TS = "2026-05-01T08:00:00Z"


def test_message_usage(spark, tmp_path):
    write(
        tmp_path, "m.jsonl",
        said(TS, "a", input_tokens=11, cache_creation_input_tokens=3, cache_read_input_tokens=2, output_tokens=7),
        said("2026-05-01T08:00:09Z", "a", input_tokens=11, cache_creation_input_tokens=3, cache_read_input_tokens=2, output_tokens=7),
        said(TS, "a", input_tokens=11, cache_creation_input_tokens=3, cache_read_input_tokens=2, output_tokens=8),
    )
    events = sorted(message(spark, tmp_path).collect(), key=lambda e: e.total_tokens)
    assert [(e.input_tokens, e.cached_input_tokens, e.total_tokens) for e in events] == [(16, 5, 23), (16, 5, 24)]
    assert events[0].line_number == 1
    assert events[0].event_key.startswith("claude-code|local_jsonl|c-1|ca978112ca1bbdca|claude-x|")


def test_flat_line_without_total(spark, tmp_path):
    write(
        tmp_path, "f.jsonl",
        {"session_id": "f-1", "model": "m", "time": TS, "input_tokens": 100, "cached_input_tokens": 40,
         "output_tokens": 10, "reasoning_output_tokens": 3},
    )
    (event,) = message(spark, tmp_path).collect()
    assert (event.input_tokens, event.cached_input_tokens, event.total_tokens) == (100, 40, 113)


def test_tool_result_takes_a_later_model(spark, tmp_path):
    write(
        tmp_path, "t.jsonl",
        {"sessionId": "c-1", "timestamp": TS, "uuid": "u1", "toolUseResult": {"usage": usage(input_tokens=5)}},
        {"sessionId": "c-1", "timestamp": TS, "toolUseResult": "plain text", "message": "also text"},
        said("2026-05-01T08:00:02Z", "b", input_tokens=1),
    )
    events = message(spark, tmp_path).collect()
    assert len(events) == 2 and {e.model for e in events} == {"claude-x"}
    assert all("|claude-x|" in e.event_key for e in events)


def test_shapes_fall_through_but_failures_do_not(spark, tmp_path):
    empty_message = said(TS, "a", input_tokens=0)
    empty_message.update(uuid="u", toolUseResult={"usage": usage(output_tokens=4)})
    bad_time = said("yesterday", "b", input_tokens=3)
    bad_time.update(input_tokens=9)
    write(tmp_path, "x.jsonl", empty_message, bad_time)
    records = message_log_records(message_log_lines(spark, str(tmp_path)))
    assert [(r["shape"]) for r in records.orderBy("line_no").collect()] == ["tool_result", "failed"]
    assert dropped_lines(records).first().dropped_lines == 1


def test_source_modes(spark, tmp_path):
    write(tmp_path, "h.jsonl", said(TS, "a", input_tokens=3))
    row = usage_telemetry(spark, str(tmp_path), "hook").first()
    assert (row.source_kind, row.source_quality) == ("hook_metadata", "estimated")
    with pytest.raises(ValueError):
        tag_source(spark.range(1), "other")


def test_both_logs_together(spark, tmp_path):
    write(tmp_path / "a", "a.jsonl", meta("s"), context("g"), token(TS, 15), token("2026-05-01T08:00:01Z", 30))
    write(tmp_path / "b", "b.jsonl", said(TS, "m", input_tokens=16, output_tokens=7))
    both = all_tool_events(
        snapshot(spark, tmp_path / "a"), message(spark, tmp_path / "b"), date(2026, 5, 1), date(2026, 5, 1)
    )
    totals = {r.tool: r.total_tokens for r in usage_rollup(both, ["tool"], LOCAL).collect()}
    assert totals == {"codex": 30, "claude-code": 23}


def test_line_numbers_survive_block_splits(spark, tmp_path):
    lines = [json.dumps({"n": n, "pad": "x" * (n % 97)}) if n % 10 else "" for n in range(1, 5001)]
    path = write(tmp_path, "long.jsonl", *lines)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        read = session_lines(spark, str(tmp_path))
        assert read.select(F.get_json_object("line", "$.n").cast("bigint").alias("n"), "line_no").filter(
            "n <> line_no"
        ).isEmpty()
        assert read.count() == 4500
        assert file_line_counts(spark, str(tmp_path)).first().last_line == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert path.exists()


def test_segments_agree_with_one_window(spark, tmp_path):
    lines = []
    total = 0
    for n in range(200):
        if n % 31 == 5:
            lines.append(context(f"model-{n % 3}"))
        if n % 47 == 11:
            lines.append(meta(f"s-{n}"))
        total = 3 if n % 60 == 59 else total + n % 4
        lines.append(token(f"2026-05-01T08:{n // 60:02d}:{n % 60:02d}Z", total))
    write(tmp_path, "long.jsonl", *lines)
    records = snapshot_log_records(snapshot_log_lines(spark, str(tmp_path)))

    def rows(segment_rows):
        deltas = cumulative_to_delta(carry_context(records, segment_rows))
        return sorted(tuple(r) for r in deltas.select("line_no", "session_id", "model", *TOKENS).collect())

    assert rows(7) == rows(10**6)


def test_series_shuffle_is_shared(spark, tmp_path):
    write(tmp_path, "a.jsonl", meta("s"), context("g"), token(TS, 15))
    events = snapshot(spark, tmp_path)
    events.collect()
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("on_error", ["continue", "fail"])
def test_the_reading_unit_does_not_change_the_store(spark, tmp_path, on_error):
    logs = tmp_path / "logs"
    write(logs, "a.jsonl", token("2026-04-30T10:00:00Z", 7), token("2026-04-30T10:00:01Z", 9))
    write(logs, "b.jsonl", token("2026-04-30", 1), token("2026-04-30T10:00:02Z", 4))
    write(logs, "c.jsonl", token("2026-04-30T10:00:03Z", 5))
    stores = []
    for size in (1, 2, 20_000):
        tables = Tables(str(tmp_path / f"store{size}"))
        try:
            incremental_refresh(spark, str(logs), None, tables, ZONE, 1, NOW, on_error, files_per_read=size)
        except RuntimeError:
            assert on_error == "fail"
        rows = read_runs(spark, tables.events, LOCAL_SCHEMA).drop("seq").collect()
        stores.append(sorted(map(str, rows)))
    assert stores[0] == stores[1] == stores[2]
    assert len(stores[0]) == (4 if on_error == "continue" else 0)


def test_a_repeated_run_keeps_earlier_files(spark, tmp_path):
    logs, tables = tmp_path / "logs", Tables(str(tmp_path / "store"))
    write(logs, "a.jsonl", token("2026-04-30T10:00:00Z", 7))
    incremental_refresh(spark, str(logs), None, tables, ZONE, 1, NOW)
    write(logs, "b.jsonl", token("2026-04-30T10:00:01Z", 9))
    incremental_refresh(spark, str(logs), None, tables, ZONE, 1, NOW)
    assert read_runs(spark, tables.events, LOCAL_SCHEMA).count() == 2
    assert current_manifest(spark, tables).count() == 2


def test_a_refresh_that_fails_before_its_commit_is_repeated_whole(spark, tmp_path, monkeypatch):
    logs, tables = tmp_path / "logs", Tables(str(tmp_path / "store"))
    write(logs, "a.jsonl", token("2026-04-30T10:00:00Z", 7))
    with monkeypatch.context() as patch:
        patch.setattr(jobs.Attempt, "commit", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental_refresh(spark, str(logs), None, tables, ZONE, 1, NOW)
    assert read_runs(spark, tables.events, LOCAL_SCHEMA).count() == 0
    assert incremental_refresh(spark, str(logs), None, tables, ZONE, 1, NOW)["events_inserted"] == 1
    assert read_runs(spark, tables.events, LOCAL_SCHEMA).count() == 1
