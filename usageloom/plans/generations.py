"""Generations of a store: many attempts merged into one, and the old ones removed.

A generation is a commit like any other. It names, for each month of the events,
the one attempt that holds it: months that got events since the last generation
are written anew, all others stay where they are, so a closed month is written
once. The upload ledger and the manifest, a row per upload and per file, are
written whole. Writing removes nothing: readers that began before see the
folders they listed.

Removal is a step of its own. A reader that runs long takes a lease, and folders
that a generation has replaced are kept while a lease is older than it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.operators.idempotent import latest_per_key
from usageloom.plans.store import (
    GENERATION_RUN,
    GENERATION_SCHEMA,
    KEY_RUN,
    MANIFEST_SCHEMA,
    SESSION_RUN,
    UPLOAD_SCHEMA,
    Attempt,
    Tables,
    committed_since,
    existing,
    generation_months,
    month_folder,
    month_rows,
    newest_commit,
    read_commits,
    read_runs,
)
from usageloom.session import remove_folder

#: A lease older than this belongs to a reader that died; so does an uncommitted attempt.
PATIENCE = timedelta(days=1)
_LEASE_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("since", T.LongType())])


def current_manifest(spark: SparkSession, tables: Tables) -> DataFrame:
    """The last row of each file."""
    rows = read_runs(spark, tables.manifest, MANIFEST_SCHEMA, monthly=False)
    return latest_per_key(rows, ("tool", "path"), ("scanned_at", "seq")).drop("seq")


def write_generation(spark: SparkSession, tables: Tables, schema: T.StructType) -> int:
    """Merge the attempts since the last generation into a new one; returns its place.

    Rows of a month are rebalanced by size, so a hot month is written by many tasks.
    """
    base = newest_commit(spark, tables, GENERATION_RUN)
    months = generation_months(spark, tables, base) if base else {}
    rows = committed_since(spark, tables.events, schema, base.seq if base else 0)
    touched = [r.year_month for r in rows.select("year_month").distinct().collect()]
    attempt = Attempt.begin(spark, tables, GENERATION_RUN)
    if touched:
        again = {m: months[m] for m in touched if m in months}
        columns = [*schema.names, "year_month"]
        merged = month_rows(spark, tables, schema, again, 0).select(*columns).unionByName(rows.select(*columns))
        (
            merged.hint("rebalance", "year_month")
            .sortWithinPartitions("year_month", "event_ts")
            .write.partitionBy("year_month")
            .parquet(attempt.folder(tables.events))
        )
    attempt.write(read_runs(spark, tables.uploads, UPLOAD_SCHEMA, monthly=False).drop("seq"), tables.uploads)
    attempt.write(current_manifest(spark, tables), tables.manifest)
    placed = {**months, **dict.fromkeys(touched, attempt.name)}
    attempt.write(spark.createDataFrame(list(placed.items()), GENERATION_SCHEMA).coalesce(1), tables.generations)
    return attempt.commit()


@contextmanager
def reading(spark: SparkSession, tables: Tables) -> Iterator[None]:
    """Hold the folders a reader may list from now on, until the block ends."""
    seq = read_commits(spark, tables).agg(F.max("seq")).first()[0] or 0
    lease = f"{tables.leases}/lease={uuid.uuid4().hex}"
    now = int(datetime.now(timezone.utc).timestamp())
    spark.createDataFrame([(seq, now)], _LEASE_SCHEMA).coalesce(1).write.parquet(lease)
    try:
        yield
    finally:
        remove_folder(spark, lease)


def _folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of the last change) of the folders below a path."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s for s in files.listStatus(folder) if s.isDirectory()]
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found]


def retire(spark: SparkSession, tables: Tables, patience: timedelta = PATIENCE) -> int:
    """Remove folders that a derived table has replaced, and attempts that never committed.

    Replaced folders stay while a reader's lease is older than what replaced
    them; events also stay until the key table covers them. Registry versions,
    results, outboxes and cursors are history and stay. Uncommitted attempts and
    leases older than ``patience`` belong to runs that died. Removing is
    repeatable, so an interrupted call is finished by the next. Returns the
    number of folders removed.
    """
    oldest = datetime.now(timezone.utc).timestamp() - patience.total_seconds()
    leases = existing(spark, tables.leases, T.StructType([*_LEASE_SCHEMA.fields, T.StructField("lease", T.StringType())]))
    limit = leases.where(F.col("since") >= oldest).agg(F.min("seq")).first()[0]
    commits = {r.attempt: r for r in read_commits(spark, tables).collect()}
    base, keys, summary = (newest_commit(spark, tables, run, limit) for run in (GENERATION_RUN, KEY_RUN, SESSION_RUN))
    months = generation_months(spark, tables, base) if base else {}
    # Attempts before these places are replaced.
    merged = base.seq if base else 0
    replaced = {
        tables.events: min(merged, keys.seq if keys else 0),
        tables.uploads: merged,
        tables.manifest: merged,
        tables.generations: merged,
        tables.keys: keys.seq if keys else 0,
        tables.session_days: summary.seq if summary else 0,
        tables.session_calls: summary.seq if summary else 0,
    }
    kept = (tables.results, tables.registry, tables.outbox, tables.reached, tables.replies, tables.cursors)
    gone: list[str] = []
    for path in (*replaced, *kept):
        for name, changed in _folders(spark, path):
            if not name.startswith("attempt="):
                continue
            place = commits.get(name.removeprefix("attempt="))
            if place is None:
                gone += [f"{path}/{name}"] if changed < oldest else []
            elif place.seq < replaced.get(path, 0):
                own = {month_folder(m) for m, attempt in months.items() if attempt == place.attempt}
                if path != tables.events or not own:
                    gone.append(f"{path}/{name}")
                else:
                    gone += [f"{path}/{name}/{month}" for month, _ in _folders(spark, f"{path}/{name}") if month not in own]
    for path in gone:
        remove_folder(spark, path)
    return len(gone)
