"""Merging a store's attempts, readers meanwhile, and what is removed when."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from test_sessions import batch, insert
from usageloom.plans import generations, jobs
from usageloom.plans.store import GENERATION_RUN, read_commits
from usageloom.session import job_scratch, scratch_dir, stage
from usageloom.sources import facts

NONE = timedelta(0)


def add(spark, tables, ids, run_id, commit=True):
    attempt = jobs.Attempt.begin(spark, tables, run_id)
    attempt.write_events(batch(spark, ids).coalesce(1))
    if commit:
        attempt.commit()
    return attempt


def events(spark, tables):
    return jobs.read_runs(spark, tables.events, jobs.LOCAL_SCHEMA)


def rows(df):
    return sorted(df.select("event_key", "event_ts", "local_date", "total_tokens", "year_month").collect())


def attempts(df):
    return {part for f in df.inputFiles() for part in f.split("/") if part.startswith("attempt=")}


def names(path):
    return {n for n in os.listdir(path) if n.startswith("attempt=")}


def test_fifty_runs_become_one_generation(spark, tmp_path):
    tables = jobs.Tables(f"{tmp_path}/store")
    # Fifty commits at once, each with folders of its own.
    own = F.lpad(F.regexp_extract("event_key", "[0-9]+", 0), 2, "0")
    rows_of = batch(spark, range(50)).withColumns({"attempt": own, "year_month": facts.year_month(F.col("local_date"))})
    rows_of.write.partitionBy("attempt", "year_month").parquet(tables.events)
    commits = spark.range(50).select(
        F.col("id").cast("string").alias("run_id"), (F.col("id") + 1).alias("seq"), F.lpad(F.col("id").cast("string"), 2, "0").alias("attempt")
    )
    commits.coalesce(1).write.partitionBy("attempt").parquet(tables.commits)
    before = events(spark, tables)
    expected = rows(before)
    assert len(attempts(before)) == 50
    with generations.reading(spark, tables):
        jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
        after = events(spark, tables)
        assert len(attempts(after)) == 1 and rows(after) == expected
        # The reader holds a lease: nothing it listed goes, and it reads the same rows.
        generations.retire(spark, tables)
        assert rows(before) == expected
    assert generations.retire(spark, tables) > 0
    assert names(tables.events) == attempts(after) and rows(events(spark, tables)) == expected
    assert generations.retire(spark, tables) == 0


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Two generations; the second one's events fall into one of two months."""
    tables = jobs.Tables(str(tmp_path_factory.mktemp("generations") / "store"))
    insert(spark, tables, batch(spark, range(0, 20)), 1)
    # A row without a date lies in a month of its own.
    attempt = jobs.Attempt.begin(spark, tables, 2)
    attempt.write_events(batch(spark, [500]).withColumn("local_date", F.lit(None).cast("date")))
    attempt.commit()
    jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
    first = events(spark, tables)
    insert(spark, tables, batch(spark, range(20, 30)), 3)
    jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
    return tables, first


def test_closed_months_are_not_written_again(spark, grown):
    tables, first = grown
    now = events(spark, tables)
    assert {r.year_month for r in now.select("year_month").distinct().collect()} == {202605, None}
    assert len(attempts(now)) == 2
    own = lambda df, month: {f for f in df.inputFiles() if f"year_month={month}/" in f}
    assert own(first, "__HIVE_DEFAULT_PARTITION__") == own(now, "__HIVE_DEFAULT_PARTITION__") != set()
    assert not own(first, 202605) & own(now, 202605)
    assert {r.event_key for r in now.collect()} >= {"k0", "k19", "k29", "k500"}
    assert now.count() == now.select("event_key").distinct().count()


def test_keys_of_merged_attempts_are_still_known(spark, grown):
    tables, _ = grown
    expected = rows(events(spark, tables))
    dead = add(spark, tables, [900], "dead", commit=False)
    generations.retire(spark, tables)
    assert f"attempt={dead.name}" in names(tables.events)
    generations.retire(spark, tables, patience=NONE)
    assert f"attempt={dead.name}" not in names(tables.events)
    assert rows(events(spark, tables)) == expected
    # Neither events nor keys of the replaced attempts are there, and yet a replay adds nothing.
    assert insert(spark, tables, batch(spark, range(0, 30)), 4) == 0
    assert rows(events(spark, tables)) == expected
    assert jobs.session_summary(spark, tables)[0].agg(F.sum("usage_event_count")).first()[0] == len(expected) - 1


def test_a_lease_keeps_what_was_replaced_after_it_and_dies_with_patience(spark, tmp_path):
    tables = jobs.Tables(f"{tmp_path}/store")
    add(spark, tables, range(3), 1)
    jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
    held = generations.reading(spark, tables)
    held.__enter__()
    reader = events(spark, tables)
    expected = rows(reader)
    add(spark, tables, range(3, 6), 2)
    jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
    # What the first generation replaced goes, what the second one did stays.
    assert generations.retire(spark, tables) == 1
    assert rows(reader) == expected and len(rows(events(spark, tables))) > len(expected)
    assert generations.retire(spark, tables, patience=NONE - timedelta(hours=1)) > 0
    assert len(names(tables.events)) == 1
    held.__exit__(None, None, None)


def test_generations_come_by_themselves_and_an_empty_store_has_one(spark, tmp_path):
    tables = jobs.Tables(f"{tmp_path}/store")
    jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
    assert events(spark, tables).count() == 0 and generations.retire(spark, tables) == 0
    add(spark, tables, range(4), 1)
    for _ in range(3):
        jobs.keep_generation(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS, every=1)
    made = read_commits(spark, tables).where(F.col("run_id") == GENERATION_RUN).count()
    assert made == 2 and events(spark, tables).count() == 5


def test_staged_tables_go_with_their_job(spark):
    with job_scratch(spark, "job") as folder:
        staged = stage(spark, spark.range(3).toDF("n"), "numbers")
        assert staged.count() == 3 and staged.inputFiles()[0].startswith(f"file://{folder}/")
    assert not os.path.exists(folder) and folder not in scratch_dir(spark, "later")
