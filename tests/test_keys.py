"""The key table: equal to a scan of the store, without moving or reading more than needed."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from test_team import ZONE, row, team_rows
from usageloom.operators.idempotent import not_stored
from usageloom.plans import jobs
from usageloom.session import settings
from usageloom.sources import key_table
from usageloom.sources.key_table import KeyLayout, not_in_table, read_keys, stored_among, write_keys

LAYOUT = KeyLayout(("team_id", "user_id", "device_id", "event_key"), by=("team_id", "user_id", "device_id"), slots=8, buckets=4)


def keys(spark, first, last, devices=20):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % devices)
    return spark.range(first, last).select(
        F.lit("t").alias("team_id"), F.lit("u").alias("user_id"), F.concat(F.lit("d"), hot).alias("device_id"),
        F.concat(F.lit("k"), F.col("id")).alias("event_key"), F.col("id").alias("n"),
    )


def plan_of(df):
    """The plan as planned, then each node with its full description."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("pushed", [0, 2000])
def test_lookup_equals_a_scan_of_all_keys(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(key_table, "PUSHED_KEYS", pushed)
    stored = keys(spark, 0, 900)
    write_keys(stored.unionByName(stored), f"{tmp_path}/keys", LAYOUT)
    table = read_keys(spark, f"{tmp_path}/keys", LAYOUT)
    assert table.count() == 900
    odd = keys(spark, 850, 950).withColumn("event_key", F.when(F.col("n") % 9 == 0, None).otherwise(F.col("event_key")))
    batch = odd.unionByName(odd.limit(5))
    want = sorted(map(tuple, not_stored(batch, stored, LAYOUT.key).collect()), key=str)
    assert sorted(map(tuple, not_in_table(batch, table, LAYOUT).collect()), key=str) == want
    assert not_in_table(batch.limit(0), table, LAYOUT).count() == 0


def test_the_stored_side_is_not_moved_and_only_the_batch_slots_are_read(spark, tmp_path):
    write_keys(keys(spark, 0, 900), f"{tmp_path}/keys", LAYOUT)
    table = read_keys(spark, f"{tmp_path}/keys", LAYOUT)
    keys(spark, 890, 1000).filter("n % 20 = 1").write.parquet(f"{tmp_path}/batch")
    batch = spark.read.parquet(f"{tmp_path}/batch")
    slots = [r.slot for r in batch.select(LAYOUT.slot().alias("slot")).distinct().collect()]
    assert 0 < len(slots) < LAYOUT.slots
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        plan = plan_of(stored_among(batch, table, LAYOUT, slots))
    tree, nodes = plan.split("\n\n", 1)
    scan = next(n for n in nodes.split("\n\n") if "Scan parquet spark_catalog" in n and "Bucketed" in n)
    assert "Bucketed: true" in scan and "SelectedBucketsCount: 4 out of 4" in scan
    assert "PartitionFilters: [slot" in scan
    # Long descriptions cut the list of folders short; the filter on folders is whole.
    folders = next(line for line in scan.split("\n") if line.startswith("PartitionFilters"))
    assert sorted(map(int, re.findall(r"\b\d+\b", folders.split("slot", 1)[1].split(" ", 1)[1]))) == sorted(slots)
    # Only the batch is dealt again, not the stored side.
    assert tree.count("Exchange") == 1
    stored_side = tree[: tree.index("Scan parquet spark_catalog")]
    assert "Exchange" not in stored_side.split("SortMergeJoin")[1]


def test_a_small_batch_is_pushed_and_the_bloom_filter_drops_files(spark, tmp_path):
    write_keys(keys(spark, 0, 900), f"{tmp_path}/keys", LAYOUT)
    table = read_keys(spark, f"{tmp_path}/keys", LAYOUT)

    def rows_read(key):
        found = table.where(F.col("event_key").isin([key]))
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    # k4445 lies between the least and greatest key of most files, and is in none.
    assert rows_read("k4445") <= 60
    assert rows_read("k444") >= 1


def test_another_session_finds_the_buckets(spark, tmp_path):
    write_keys(keys(spark, 0, 100), f"{tmp_path}/keys", LAYOUT)
    spark.sql(f"DROP TABLE {key_table._name(f'{tmp_path}/keys')}")
    assert read_keys(spark, f"{tmp_path}/keys", LAYOUT).count() == 100


def test_the_store_reads_its_key_table_and_the_commits_after_it(spark, tmp_path, monkeypatch):
    tables = jobs.Tables(f"{tmp_path}/store")

    def insert(run_id, *names):
        rows = team_rows(spark, *[row("2026-05-01T08:00:00", name) for name in names]).withColumns(
            {"received_at": F.col("event_ts"), "source_kind": F.lit(""), "source_quality": F.lit(""), "local_date": F.lit(date(2026, 5, 1))}
        ).select(*jobs.TEAM_SCHEMA.names)
        new = jobs.stored_events(spark, tables, jobs.TEAM_SCHEMA, jobs.TEAM_KEYS)(rows)
        attempt = jobs.Attempt.begin(spark, tables, run_id)
        attempt.write_events(new)
        attempt.commit()
        jobs.keep_key_table(spark, tables, jobs.TEAM_SCHEMA, jobs.TEAM_KEYS, every=2)

    insert(1, "a", "b")
    assert jobs._key_table(spark, tables) is None
    insert(2, "b", "c")
    first = jobs._key_table(spark, tables)
    insert(3, "a", "d")
    # An attempt that never commits stores nothing.
    jobs.Attempt.begin(spark, tables, 4).write_events(
        jobs.read_runs(spark, tables.events, jobs.TEAM_SCHEMA).drop("seq", "year_month").withColumn("event_key", F.lit("lost"))
    )
    recent = jobs.committed_since(spark, tables.events, jobs.TEAM_SCHEMA, first.seq)
    assert [r.event_key for r in recent.collect()] == ["d"]
    insert(5, "d", "lost", "e")
    assert jobs._key_table(spark, tables).seq > first.seq
    insert(6, "a", "b", "c", "d", "e", "lost")
    stored = jobs.read_runs(spark, tables.events, jobs.TEAM_SCHEMA)
    assert sorted(r.event_key for r in stored.collect()) == ["a", "b", "c", "d", "e", "lost"]
