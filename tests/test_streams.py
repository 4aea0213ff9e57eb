"""Active time as an append-mode stream: state ends, late rows are counted, nothing else is lost."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from usageloom.model import TEAM, TOKENS
from usageloom.streaming import closing_days, running
from usageloom.streaming.closing_days import ClosingDays

START = datetime(2026, 5, 1)


def events(spark, *rows):
    """(session, minutes after the start)"""
    data = [(START + timedelta(minutes=m), "t", "u", "d", s) for s, m in rows]
    return spark.createDataFrame(data, "event_ts timestamp, team_id string, user_id string, device_id string, session_id string")


def per_session(stretches):
    found = stretches.groupBy("session_id").agg(F.sum("active_seconds"), F.sum("usage_event_count"))
    return {r[0]: (r[1], r[2]) for r in found.collect()}


def test_append_mode_closes_stretches_and_counts_late_rows(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        stream = spark.readStream.schema(events(spark).schema).parquet(f"{source}/*")
        query = running.run_to_table(running.stream_active_time(stream, "1 hour"), out, checkpoint, "append")
        query.awaitTermination()
        return query

    first = events(spark, ("a", 0), ("a", 20), ("a", 100), ("b", 5))
    first.write.parquet(f"{source}/1")
    one = run()
    assert running.late_rows(one) == 0
    rows_then = one.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    second = events(spark, ("c", 300), ("c", 329), ("c", 700), ("a", 690))
    second.write.parquet(f"{source}/2")
    two = run()
    # The stretch this one belongs to closed long ago.
    events(spark, ("a", 30)).write.parquet(f"{source}/3")
    three = run()
    assert running.late_rows(three) == 1
    whole = first.unionByName(second)
    closed = spark.read.parquet(out)
    held = running.open_stretches(whole, running.watermark_of(three))
    assert per_session(closed.select(*held.columns).unionByName(held)) == per_session(running.open_stretches(whole, None))
    assert {(r.session_id, r.active_seconds) for r in held.collect()} == {("c", 0), ("a", 0)}
    # Seven stretches passed through; state holds the open ones only.
    assert three.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == held.count() == 2
    assert rows_then <= 3 and closed.count() == 4
    assert set(TEAM.session) <= set(closed.columns) and two is not three


def test_an_open_stretch_keeps_its_early_events(spark):
    """Its first event's own window ends before the watermark, the merged one after it."""
    held = running.open_stretches(events(spark, ("a", 0), ("a", 25), ("a", 50), ("b", 0)), "2026-05-01T01:00:00.000Z")
    assert {(r.session_id, r.active_seconds, r.usage_event_count) for r in held.collect()} == {("a", 3000, 3)}


def test_nothing_held_back_without_a_watermark(spark):
    assert running.open_stretches(events(spark, ("a", 0)), None).count() == 1


def usage(spark, *rows):
    """(hours after the start or none, team, tokens)"""
    data = [(None if h is None else START + timedelta(hours=h), t, "codex", *[n] * len(TOKENS)) for h, t, n in rows]
    schema = "event_ts timestamp, team_id string, tool string, " + ", ".join(f"{t} bigint" for t in TOKENS)
    return spark.createDataFrame(data, schema)


def sums(days):
    return {(str(r.local_date), r.team_id): (r.total_tokens, r.usage_event_count) for r in days.collect()}


def test_days_close_and_late_rows_go_aside(spark, tmp_path):
    days = ClosingDays(f"{tmp_path}/days", "Asia/Shanghai", "2 hours")
    schema = usage(spark).schema

    def run(number, *rows):
        usage(spark, *rows).write.parquet(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        days.start(stream, f"{tmp_path}/checkpoint").awaitTermination()

    # The first local day ends after 16 hours; 17 hours is within the horizon.
    run(1, (0, "t", 1), (15, "t", 2), (17, "t", 4))
    assert sums(days.closed_days(spark)) == {}
    assert sums(days.open_days(spark)) == {("2026-05-01", "t"): (3, 2), ("2026-05-02", "t"): (4, 1)}
    # A row of the first day that comes with the row closing it still counts.
    run(2, (3, "t", 8), (3, None, 5), (18, "t", 16))
    closed = {("2026-05-01", "t"): (11, 3), ("2026-05-01", None): (5, 1)}
    assert sums(days.closed_days(spark)) == closed
    assert sums(days.open_days(spark)) == {("2026-05-02", "t"): (20, 2)}
    run(3, (3, "t", 100), (None, "t", 7), (19, "t", 32))
    assert sums(days.closed_days(spark)) == closed
    assert sums(days.open_days(spark)) == {("2026-05-02", "t"): (52, 3)}
    late = days.late_rows(spark, schema).collect()
    assert sorted((r.batch_id, r.total_tokens) for r in late) == [(2, 7), (2, 100)]
    # The closed day's partial sums are gone.
    assert [r.local_date.day for r in days._partials(spark).select("local_date").distinct().collect()] == [2]
    # A repeated batch changes nothing.
    days.take(usage(spark, (3, "t", 100), (None, "t", 7), (19, "t", 32)), 2)
    assert sums(days.closed_days(spark)) == closed and sums(days.open_days(spark)) == {("2026-05-02", "t"): (52, 3)}
    assert days.late_rows(spark, schema).count() == 2


def test_a_batch_that_failed_before_its_mark_is_repeated_whole(spark, tmp_path):
    days = ClosingDays(f"{tmp_path}/days", "UTC", "1 hour")
    days.take(usage(spark, (0, "t", 1), (20, "t", 2)), 0)
    with pytest.MonkeyPatch.context() as broken:
        broken.setattr(closing_days, "_merged", lambda rows: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            days.take(usage(spark, (1, "t", 4), (30, "u", 8)), 1)
    days.take(usage(spark, (1, "t", 4), (30, "u", 8)), 1)
    assert sums(days.closed_days(spark)) == {("2026-05-01", "t"): (7, 3)}
    assert sums(days.open_days(spark)) == {("2026-05-02", "u"): (8, 1)}


def test_no_rows_close_no_days(spark, tmp_path):
    days = ClosingDays(f"{tmp_path}/days", "UTC", "1 hour")
    days.take(usage(spark), 0)
    assert days.closed_days(spark).count() == days.open_days(spark).count() == days.late_rows(spark, usage(spark).schema).count() == 0
