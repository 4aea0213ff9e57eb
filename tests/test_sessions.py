"""The stored session summary: equal to the events, whatever the commits, and read in their place."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from test_grains import scans
from test_team import ZONE, row, team_rows
from usageloom.operators.idempotent import insert_new_events
from usageloom.plans import jobs, local_reports, periods, sessions

SPAN = periods.resolve_range(date(2026, 5, 17), month="2026-05")


def batch(spark, ids):
    rows = [
        row(
            f"2026-0{4 + (i % 40) // 38}-{1 + i % 28:02d}T{i * 5 % 24:02d}:{i * 17 % 60:02d}:00" if i % 40 >= 38 else f"2026-05-{1 + i % 28:02d}T{i * 5 % 24:02d}:{i * 17 % 60:02d}:00",
            f"k{i}", session=f"s{i % 23}", tool=("codex", "claude-code")[i % 2], model=f"m{i % 3}", tokens=(i % 9, 1, 2, 0, i % 9 + 2),
        )
        for i in ids
    ]
    # The same call under a second key, in whatever commit it arrives.
    rows += [(*r[:6], r[6] + "-again", *r[7:]) for r, i in zip(rows, ids) if i % 10 == 3]
    return team_rows(spark, *rows).withColumns(
        {"source_kind": F.lit(""), "source_quality": F.lit(""), "source_path": F.lit("p"), "line_number": F.lit(1).cast("long")}
    ).select(*jobs.LOCAL_SCHEMA.names)


def insert(spark, tables, events, run_id):
    new = insert_new_events(
        events, jobs.stored_events(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS), ("event_key",), ("source_path", "line_number"),
        keep=lambda first: jobs.stage(spark, first, "first"),
    )
    attempt = jobs.Attempt.begin(spark, tables, run_id)
    count = jobs.store_local_events(spark, tables, attempt, new)
    attempt.commit()
    return count


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    tables = jobs.Tables(str(tmp_path_factory.mktemp("sessions") / "store"))
    assert insert(spark, tables, batch(spark, range(0, 120)), 1) > 120
    assert insert(spark, tables, batch(spark, range(60, 160)), 2) < 60
    jobs.merge_session_summary(spark, tables)
    insert(spark, tables, batch(spark, range(150, 230)), 3)
    # A replay adds nothing, and an attempt that never commits is not seen.
    assert insert(spark, tables, batch(spark, range(0, 230)), 4) == 0
    jobs.store_local_events(spark, tables, jobs.Attempt.begin(spark, tables, 5), batch(spark, range(300, 330)))
    return tables


def month(spark, store):
    stored = jobs.read_runs(spark, store.events, jobs.LOCAL_SCHEMA)
    return stored.where(F.col("local_date").between(F.lit(SPAN.start), F.lit(SPAN.end)))


def test_sessions_from_the_summary_equal_those_from_events(spark, store):
    _, calls = jobs.session_summary(spark, store)
    want = local_reports.local_sessions(month(spark, store))
    got = sessions.summary_sessions(calls, SPAN)
    assert got.columns == want.columns
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize(("page", "size"), [(1, 10), (2, 10), (3, 10), (4, 10), (2, 7)])
def test_pages_equal_those_from_events(spark, store, page, size):
    days, calls = jobs.session_summary(spark, store)
    want, want_info = local_reports.local_sessions_page(month(spark, store), page, size)
    got, info = sessions.summary_page(days, calls, SPAN, page, size)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert info.collect() == want_info.collect()


def test_a_page_reads_no_event_and_only_the_folders_of_its_sessions(spark, store):
    days, calls = jobs.session_summary(spark, store)
    page, info = sessions.summary_page(days, calls, SPAN, 1, 2)
    assert scans(page, store.events) == 0 and scans(info, store.events) == 0
    plan = page._sc._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    scan = [n for n in plan.split("\n\n") if "Scan parquet" in n and "Location" in n]
    assert scan and all("session_calls" in n and "bucket" in n.split("PartitionFilters")[1].split("\n")[0] for n in scan)
    assert all("In(session_id" in n for n in scan)


def test_a_generation_replaces_the_parts_before_it(spark, store):
    before = sorted(map(str, sessions.merged_calls(jobs.session_summary(spark, store)[1]).collect()))
    jobs.merge_session_summary(spark, store)
    days, calls = jobs.session_summary(spark, store)
    assert sorted(map(str, calls.select(*sessions.CALL_SCHEMA.names, "bucket").collect())) == before
    assert calls.select("attempt").distinct().count() == 1 and days.select("attempt").distinct().count() == 1
    assert days.count() == days.select("session_id", "local_date").distinct().count()


def test_pages_of_an_empty_store(spark, tmp_path):
    days, calls = jobs.session_summary(spark, jobs.Tables(f"{tmp_path}/none"))
    page, info = sessions.summary_page(days, calls, SPAN)
    assert page.count() == 0 and tuple(info.first()) == (1, 10, 0, 1)
    with pytest.raises(ValueError):
        sessions.summary_page(days, calls, SPAN, 1, 11)
