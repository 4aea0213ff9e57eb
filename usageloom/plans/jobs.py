"""Batch jobs that read and write tables. One writer per table at a time.

Every write of a run goes to a fresh ``attempt=…`` folder, and one commit row
makes all folders of the attempt visible at once. A run that fails leaves
nothing that readers see, whatever it wrote before; repeating it starts afresh.
Repeating a committed ingest run changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.model import DEVICE
from usageloom.operators.decode import decode_errors, message_events, snapshot_events
from usageloom.operators.idempotent import (
    Stored,
    changed_files,
    insert_new_events,
    latest_per_key,
    manifest_rows,
    not_stored,
)
from usageloom.operators.team_ingest import (
    IngestRun,
    check_envelopes,
    ingest_checked,
    ledger_rows,
    screened_batch,
)
from usageloom.plans import generations, registry_store, sessions
from usageloom.plans.store import (
    GENERATION_RUN,
    KEY_RUN,
    LOCAL_SCHEMA,
    MANIFEST_SCHEMA,
    SESSION_RUN,
    TEAM_SCHEMA,
    UPLOAD_SCHEMA,
    Attempt,
    Tables,
    committed_since,
    existing,
    newest_commit,
    read_commits,
    read_runs,
)
from usageloom.session import job_scratch, scratch_dir, stage
from usageloom.sources.key_table import KeyLayout, not_in_table, read_keys, write_keys
from usageloom.sources.lines import file_line_counts, file_listing
from usageloom.sources.message_log import message_log_lines, message_log_records
from usageloom.sources.snapshot_log import snapshot_log_lines, snapshot_log_records

# Files named to one read; any number gives the same store.
FILES_PER_READ = 20_000


#: How the keys of a team store and of a local store are laid out.
TEAM_KEYS = KeyLayout((*DEVICE, "event_key"), by=DEVICE, slots=16, buckets=64)
LOCAL_KEYS = KeyLayout(("event_key",))
#: Commits after which the key table takes in the events stored since.
COMMITS_PER_KEY_TABLE = 20
#: Commits after which events, ledger and manifest are merged into a generation.
COMMITS_PER_GENERATION = 50


def _key_table(spark: SparkSession, tables: Tables) -> Row | None:
    return newest_commit(spark, tables, KEY_RUN)


def build_key_table(spark: SparkSession, tables: Tables, schema: T.StructType, layout: KeyLayout) -> None:
    """Write the key table anew, from the one before it and the events committed since."""
    base = _key_table(spark, tables)
    keys = committed_since(spark, tables.events, schema, base.seq if base else 0, without=GENERATION_RUN).select(*layout.key)
    attempt = Attempt.begin(spark, tables, KEY_RUN)
    if base:
        keys = keys.unionByName(read_keys(spark, f"{tables.keys}/attempt={base.attempt}", layout).select(*layout.key))
    write_keys(keys, attempt.folder(tables.keys), layout)
    attempt.commit()


def stored_events(spark: SparkSession, tables: Tables, schema: T.StructType, layout: KeyLayout) -> Stored:
    """The store as a lookup: the key table bucket by bucket, then the few commits after it."""
    base = _key_table(spark, tables)
    recent = committed_since(spark, tables.events, schema, base.seq if base else 0, without=GENERATION_RUN)

    def absent(rows: DataFrame) -> DataFrame:
        if base:
            rows = not_in_table(rows, read_keys(spark, f"{tables.keys}/attempt={base.attempt}", layout), layout)
        return not_stored(rows, recent, layout.key)

    return absent


def keep_key_table(
    spark: SparkSession, tables: Tables, schema: T.StructType, layout: KeyLayout, every: int = COMMITS_PER_KEY_TABLE
) -> None:
    """Build the key table where ``every`` commits or more came after the last one."""
    base = _key_table(spark, tables)
    if read_commits(spark, tables).filter(F.col("seq") > (base.seq if base else 0)).count() >= every:
        build_key_table(spark, tables, schema, layout)


def compact(spark: SparkSession, tables: Tables, schema: T.StructType, layout: KeyLayout) -> None:
    """Merge the store into one generation; its keys first, so that no lookup needs an attempt before it."""
    keep_key_table(spark, tables, schema, layout, every=1)
    generations.write_generation(spark, tables, schema)


def keep_generation(
    spark: SparkSession, tables: Tables, schema: T.StructType, layout: KeyLayout, every: int = COMMITS_PER_GENERATION
) -> None:
    """Compact where ``every`` commits or more came after the last generation."""
    base = newest_commit(spark, tables, GENERATION_RUN)
    if read_commits(spark, tables).filter(F.col("seq") > (base.seq if base else 0)).count() >= every:
        compact(spark, tables, schema, layout)


def session_summary(spark: SparkSession, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(days, calls) of all committed events, in parts that merge.

    The newest merged generation and the commits after it; a generation's own
    commit is one of those read.
    """
    base = newest_commit(spark, tables, SESSION_RUN)
    seq = base.seq - 1 if base else 0
    days = committed_since(spark, tables.session_days, sessions.DAY_SCHEMA, seq, [])
    return days, committed_since(spark, tables.session_calls, sessions.CALL_SCHEMA, seq, sessions.BUCKET)


def merge_session_summary(spark: SparkSession, tables: Tables) -> None:
    """Merge all parts of the summary into one generation, visible with its commit."""
    days, calls = session_summary(spark, tables)
    attempt = Attempt.begin(spark, tables, SESSION_RUN)
    attempt.write(sessions.merged_days(days), tables.session_days)
    sessions.write_calls(sessions.merged_calls(calls), attempt.folder(tables.session_calls))
    attempt.commit()


def keep_session_summary(spark: SparkSession, tables: Tables, every: int = COMMITS_PER_KEY_TABLE) -> None:
    """Merge the summary where ``every`` commits or more came after the last generation."""
    base = newest_commit(spark, tables, SESSION_RUN)
    if read_commits(spark, tables).filter(F.col("seq") > (base.seq if base else 0)).count() >= every:
        merge_session_summary(spark, tables)


def store_local_events(spark: SparkSession, tables: Tables, attempt: Attempt, fresh: DataFrame) -> int:
    """Write new events and what they add to the session summary; returns their number."""
    appended = attempt.write_events(fresh)
    attempt.write(sessions.day_rows(appended), tables.session_days)
    sessions.write_calls(sessions.call_rows(appended), attempt.folder(tables.session_calls))
    return appended.count()


def run_team_ingest(
    spark: SparkSession,
    envelopes: DataFrame,
    registry: DataFrame | None,
    tables: Tables,
    zone: str,
    run_id: int | str,
) -> DataFrame:
    """Ingest one batch of envelopes; returns the result per arrival.

    Without a ``registry`` tokens are resolved by the stored one, as of the last
    commit, and the run stores the last-seen times it moves.

    Bodies are parsed once: opened envelopes are staged, and everything else
    reads those. A run that was committed before returns its stored results.
    """
    done = read_commits(spark, tables).filter(F.col("run_id") == str(run_id)).first()
    if done is not None:
        return spark.read.parquet(f"{tables.results}/attempt={done.attempt}")
    with job_scratch(spark, "ingest"):
        written = _ingested(spark, envelopes, registry, tables, zone, run_id)
        keep_key_table(spark, tables, TEAM_SCHEMA, TEAM_KEYS)
        keep_generation(spark, tables, TEAM_SCHEMA, TEAM_KEYS)
        if registry is None:
            registry_store.keep_generation(spark, tables)
    return written


def _ingested(
    spark: SparkSession,
    envelopes: DataFrame,
    registry: DataFrame | None,
    tables: Tables,
    zone: str,
    run_id: int | str,
) -> DataFrame:
    bound = registry_store.registry_as_of(spark, tables) if registry is None else registry
    checked = stage(spark, check_envelopes(envelopes, bound).drop("body"), "opened")
    screened = stage(spark, screened_batch(checked), "screened")
    guarded = checked.drop("events")
    attempt = Attempt.begin(spark, tables, run_id)
    try:
        stored = stored_events(spark, tables, TEAM_SCHEMA, TEAM_KEYS)
        run = ingest_checked(
            guarded, screened, stored, zone, keep=lambda first: stage(spark, first, "first")
        )
        appended = attempt.write_events(run.accepted)
        written = attempt.write(run.results_given(appended), tables.results)
        attempt.write(ledger_rows(written, zone), tables.uploads)
        if registry is None:
            registry_store.write_last_seen(attempt, bound, guarded.filter(F.col("code") == "ok"))
        attempt.commit()
    except Exception as failure:
        record_failure(spark, guarded, screened, tables, zone, run_id, f"{type(failure).__name__}: {failure}"[:500])
        raise
    return written


def record_failure(
    spark: SparkSession,
    guarded: DataFrame,
    screened: DataFrame,
    tables: Tables,
    zone: str,
    run_id: int | str,
    message: str,
) -> None:
    """Ledger rows of a run whose storing failed; the run itself stays open to be repeated."""
    attempt = Attempt.begin(spark, tables, f"{run_id} failed")
    nothing = spark.createDataFrame([], "envelope_id string, arrival bigint")
    results = IngestRun(guarded, screened, nothing).results
    attempt.write(ledger_rows(results, zone, storage_error=message), tables.uploads)
    attempt.commit()


def incremental_refresh(
    spark: SparkSession,
    snapshot_paths: str | list[str] | None,
    message_paths: str | list[str] | None,
    tables: Tables,
    zone: str,
    run_id: int | str,
    scanned_at: datetime,
    on_error: str = "continue",
    files_per_read: int = FILES_PER_READ,
) -> dict[str, int]:
    """Replay changed log files into the local store.

    A changed file is read from its start: that is what makes differences of
    running totals right without any stored state. All changed files of a tool
    are decoded before one decision on errors, one choice of the first copy of
    each key and one insert. ``on_error="fail"`` stops before anything is written.
    """
    if on_error not in ("continue", "fail"):
        raise ValueError("on_error must be continue or fail")
    with job_scratch(spark, "refresh"):
        return _refreshed(spark, snapshot_paths, message_paths, tables, zone, run_id, scanned_at, on_error, files_per_read)


def _refreshed(
    spark: SparkSession,
    snapshot_paths: str | list[str] | None,
    message_paths: str | list[str] | None,
    tables: Tables,
    zone: str,
    run_id: int | str,
    scanned_at: datetime,
    on_error: str,
    files_per_read: int,
) -> dict[str, int]:
    names = ("files_scanned", "files_changed", "events_inserted", "events_skipped", "errors")
    totals = dict.fromkeys(names, 0)
    attempt = Attempt.begin(spark, tables, run_id)
    stored = stored_events(spark, tables, LOCAL_SCHEMA, LOCAL_KEYS)
    manifest = current_manifest(spark, tables)
    fresh = entries = None
    for tool, paths in (("codex", snapshot_paths), ("claude-code", message_paths)):
        if not paths:
            continue
        listing = file_listing(spark, paths, tool)
        changed = stage(spark, changed_files(listing, manifest), "changed")
        totals["files_scanned"] += listing.count()
        batch, errors, last_lines = _decoded(spark, tool, changed, zone, files_per_read)
        totals["files_changed"] += changed.count()
        totals["events_skipped"] += batch.count()
        totals["errors"] += errors.count()
        new = insert_new_events(
            batch, stored, ("event_key",), ("source_path", "line_number"),
            keep=lambda first: stage(spark, first, "first"),
        )
        rows = manifest_rows(changed, batch, errors, last_lines, scanned_at)
        fresh = new if fresh is None else fresh.unionByName(new)
        entries = rows if entries is None else entries.unionByName(rows)
    if totals["errors"] and on_error == "fail":
        raise RuntimeError(f"{totals['errors']} unreadable log lines")
    if totals["files_changed"]:
        totals["events_inserted"] = store_local_events(spark, tables, attempt, fresh)
        totals["events_skipped"] -= totals["events_inserted"]
        attempt.write(entries, tables.manifest)
        attempt.commit()
        keep_key_table(spark, tables, LOCAL_SCHEMA, LOCAL_KEYS)
        keep_generation(spark, tables, LOCAL_SCHEMA, LOCAL_KEYS)
        keep_session_summary(spark, tables)
    return totals


def _decoded(
    spark: SparkSession, tool: str, changed: DataFrame, zone: str, files_per_read: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, errors and line counts of all changed files, staged."""
    records, counts = scratch_dir(spark, "records"), scratch_dir(spark, "lines")
    for part, uris in enumerate(_slices(changed, files_per_read)):
        if tool == "codex":
            decoded = snapshot_log_records(snapshot_log_lines(spark, uris))
        else:
            decoded = message_log_records(message_log_lines(spark, uris))
        decoded.write.parquet(f"{records}/part={part}")
        file_line_counts(spark, uris).write.parquet(f"{counts}/part={part}")
    lines = existing(spark, counts, _line_schema())
    if tool == "codex":
        rows = existing(spark, records, _schema_of(spark, snapshot_log_records))
        return stage(spark, snapshot_events(rows, zone), "batch"), decode_errors(rows), lines
    rows = existing(spark, records, _schema_of(spark, message_log_records))
    none = spark.createDataFrame([], "path string, line bigint, message string")
    return stage(spark, message_events(rows, zone), "batch"), none, lines


def _line_schema() -> T.StructType:
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("last_line", T.LongType())])


def _schema_of(spark: SparkSession, decode) -> T.StructType:
    return decode(spark.createDataFrame([], "path string, line_no bigint, line string")).schema


def _slices(changed: DataFrame, size: int) -> Iterator[list[str]]:
    """File names in bounded lists; the driver never holds more than one list."""
    names = (row.uri for row in changed.select("uri").toLocalIterator())
    while part := list(islice(names, size)):
        yield part


def current_manifest(spark: SparkSession, tables: Tables) -> DataFrame:
    return generations.current_manifest(spark, tables)
