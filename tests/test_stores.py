"""Stored registry versions and the collector's commits."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from test_team import ZONE, envelopes, event, row, team_rows
from usageloom.plans import collector, jobs, registry_store
from usageloom.plans.store import committed_since, read_commits

COLUMNS = registry_store.REGISTRY_SCHEMA


def binding(spark, *rows):
    """(token, device, status)"""
    data = [(t, "t", "u", d, d.upper(), s, datetime(2026, 1, 1), None, "p") for t, d, s in rows]
    return spark.createDataFrame(data, COLUMNS)


def test_registry_versions_and_reads_as_of_a_commit(spark, tmp_path):
    tables = jobs.Tables(f"{tmp_path}/store")
    assert registry_store.registry_as_of(spark, tables).count() == 0
    one = registry_store.change_registry(spark, tables, "a", upserts=binding(spark, ("x", "d1", "active"), ("y", "d2", "active")))
    later = binding(spark, ("x", "d1", "disabled"), ("z", "d3", "active")).withColumn("created_at", F.lit(datetime(2030, 1, 1)))
    two = registry_store.change_registry(spark, tables, "b", upserts=later, removed=binding(spark, ("y", "d2", "active"), ("none", "d", "active")))
    # A repeated run changes nothing.
    assert registry_store.change_registry(spark, tables, "a", upserts=binding(spark, ("y", "d2", "active"))) == one
    state = lambda seq=None: {r.token_hash: r.status for r in registry_store.registry_as_of(spark, tables, seq).collect()}
    assert state(one) == {"x": "active", "y": "active"}
    assert state(two) == state() == {"x": "disabled", "z": "active"}
    known = {r.token_hash: r.created_at for r in registry_store.registry_as_of(spark, tables).collect()}
    assert known == {"x": datetime(2026, 1, 1), "z": datetime(2030, 1, 1)}
    registry_store.keep_generation(spark, tables, every=2)
    back = registry_store.change_registry(spark, tables, "c", upserts=binding(spark, ("y", "d2", "active")))
    assert state(one) == {"x": "active", "y": "active"} and state(two) == {"x": "disabled", "z": "active"}
    assert state() == state(back) == {"x": "disabled", "y": "active", "z": "active"}
    # Reading starts at the generation: older attempts are not listed.
    seq = next(r.seq for r in read_commits(spark, tables).collect() if r.run_id == "registry generation")
    assert committed_since(spark, tables.registry, registry_store.VERSION_SCHEMA, seq - 1, []).select("attempt").distinct().count() == 2


def test_a_run_stores_last_seen_with_its_events(spark, tmp_path, monkeypatch):
    tables = jobs.Tables(f"{tmp_path}/store")
    token = spark.createDataFrame([("token-one",)], "token string").select(F.sha2("token", 256)).first()[0]
    registry_store.change_registry(spark, tables, "a", upserts=binding(spark, (token, "dev", "active"), ("other", "d2", "active")))
    body = {"client_user_id": "u", "events": [event("k1", "2026-05-01T08:00:00Z", 5)]}
    sent = envelopes(spark, ("e1", "token-one", body))
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "ledger_rows", lambda *a, **k: (_ for _ in ()).throw(OSError("no disk")))
        with pytest.raises(OSError):
            jobs.run_team_ingest(spark, sent, None, tables, ZONE, 1)
    assert {r.last_seen_at for r in registry_store.registry_as_of(spark, tables).collect()} == {None}
    assert [r.accepted for r in jobs.run_team_ingest(spark, sent, None, tables, ZONE, 1).collect()] == [1]
    seen = {r.token_hash: r.last_seen_at for r in registry_store.registry_as_of(spark, tables).collect()}
    assert seen["other"] is None and seen[token] == sent.first().uploaded_at
    registry_store.change_registry(spark, tables, "b", removed=binding(spark, (token, "dev", "active")))
    assert [r.code for r in jobs.run_team_ingest(spark, sent, None, tables, ZONE, 2).collect()] == ["unauthorized"]


@pytest.fixture
def own(spark):
    rows = [row(f"2026-05-01T08:{i:02d}:00", f"k{i:02d}", tokens=(1, 0, 0, 0, 1)) for i in range(10)]
    return team_rows(spark, *rows).withColumns({"device_id": F.lit("dev"), "source_kind": F.lit(""), "source_quality": F.lit("")})


def run(spark, own, tables, send, cutoff, run_id):
    devices = spark.createDataFrame([("u", "dev"), ("u", "idle")], "user_id string, device_id string")
    return collector.run_collector(spark, own, devices, tables, send, f"2026-05-01 08:{cutoff}:00", date(2026, 5, 1), run_id, batch=4)


def reply(sent, ok=True, rejected=0):
    def send(outbox):
        sent.append(sorted((r.device_id, r.batch_no, r.event_count, r.body) for r in outbox.collect()))
        zero = F.lit(0).cast("long")
        return outbox.select(
            "user_id", "device_id", "batch_no", F.lit(ok).alias("ok"), zero.alias("accepted"), zero.alias("duplicate"),
            F.lit(rejected).cast("long").alias("rejected"),
        )

    return send


def cursor(spark, tables):
    return {r.device_id: r.cursor_key for r in collector.current_cursors(spark, tables).collect()}


def test_collector_moves_only_with_its_replies(spark, own, tmp_path):
    tables, sent = jobs.Tables(f"{tmp_path}/home"), []
    run(spark, own, tables, reply(sent), "03", 1)
    assert [(d, b, n) for d, b, n, _ in sent[0]] == [("dev", 0, 4), ("idle", 0, 0)] and cursor(spark, tables) == {"dev": "k03"}
    run(spark, own, tables, reply(sent, ok=False), "05", 2)
    run(spark, own, tables, reply(sent, rejected=1), "05", 3)
    assert cursor(spark, tables) == {"dev": "k03"} and sent[1] == sent[2]

    def lost(outbox):
        reply(sent)(outbox)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        run(spark, own, tables, lost, "07", 4)
    assert cursor(spark, tables) == {"dev": "k03"}
    # The same envelopes go out again, though more events are there by now.
    run(spark, own, tables, reply(sent), "09", 5)
    assert sent[4] == sent[3] and cursor(spark, tables) == {"dev": "k07"}
    run(spark, own, tables, reply(sent), "09", 6)
    assert [(d, b, n) for d, b, n, _ in sent[5]] == [("dev", 0, 2), ("idle", 0, 0)] and cursor(spark, tables) == {"dev": "k09"}
    run(spark, own, tables, reply(sent), "09", 7)
    assert [(d, b, n) for d, b, n, _ in sent[6]] == [("dev", 0, 0), ("idle", 0, 0)] and cursor(spark, tables) == {"dev": "k09"}
    # A committed run sends nothing when it is repeated.
    assert run(spark, own, tables, lost, "09", 7).count() == 2 and len(sent) == 7


def test_envelopes_without_a_reply_have_failed(spark, own, tmp_path):
    tables, sent = jobs.Tables(f"{tmp_path}/home"), []
    some = lambda outbox: reply(sent)(outbox.where("batch_no <> 1"))
    run(spark, own, tables, some, "09", 1)
    assert cursor(spark, tables) == {}
