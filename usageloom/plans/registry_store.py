"""The device registry as stored versions, read as of any commit.

A change writes only the bindings it touches, as new versions under a commit;
a removal is a version too. The registry at a commit is each token's last
version up to it. An ingest run writes the last-seen times it moves in the same
attempt as its events, so a failed run moves none. From time to time all current
versions are written as one generation, where reading starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.model import DEVICE
from usageloom.operators import registry as bindings
from usageloom.operators.idempotent import latest_per_key
from usageloom.plans.store import Attempt, Tables, committed_since, newest_commit, read_commits

REGISTRY_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("token_hash", *DEVICE, "display_name", "status")],
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("token_preview", T.StringType()),
    ]
)
VERSION_SCHEMA = T.StructType([*REGISTRY_SCHEMA.fields, T.StructField("removed", T.BooleanType())])
_GENERATION = "registry generation"
#: Commits after which a generation is written.
COMMITS_PER_GENERATION = 50


def registry_as_of(spark: SparkSession, tables: Tables, seq: int | None = None) -> DataFrame:
    """The bindings after commit ``seq``, or after the last one."""
    base = newest_commit(spark, tables, _GENERATION, seq)
    rows = committed_since(spark, tables.registry, VERSION_SCHEMA, base.seq - 1 if base else 0, [], seq)
    last = latest_per_key(rows, ("token_hash",), ("seq",))
    return last.where(~F.col("removed")).select(*REGISTRY_SCHEMA.names)


def change_registry(
    spark: SparkSession, tables: Tables, run_id: int | str, upserts: DataFrame | None = None, removed: DataFrame | None = None
) -> int:
    """Store new, changed and removed bindings in one commit; returns its place.

    A change keeps created_at and last_seen_at of a known token; a token that is
    changed and removed at once is removed. Repeating a committed run changes nothing.
    """
    done = read_commits(spark, tables).filter(F.col("run_id") == str(run_id)).first()
    if done is not None:
        return done.seq
    current = registry_as_of(spark, tables)
    gone = current.limit(0) if removed is None else bindings.left_of(current, removed)
    rows = gone.withColumn("removed", F.lit(True))
    if upserts is not None:
        fresh = bindings.replacements(current, upserts.select(*REGISTRY_SCHEMA.names))
        if removed is not None:
            fresh = bindings.remove_registry(fresh, removed)
        rows = fresh.withColumn("removed", F.lit(False)).unionByName(rows)
    attempt = Attempt.begin(spark, tables, run_id)
    attempt.write(rows.select(*VERSION_SCHEMA.names), tables.registry)
    return attempt.commit()


def write_last_seen(attempt: Attempt, current: DataFrame, seen: DataFrame) -> None:
    """Versions of the bindings whose last-seen time an upload moves, in the run's own attempt."""
    moved = bindings.touch_last_seen(current, seen).alias("new").join(
        current.select("token_hash", F.col("last_seen_at").alias("_was")), "token_hash"
    )
    later = F.col("last_seen_at") > F.coalesce("_was", F.lit("0001-01-01").cast("timestamp"))
    rows = moved.where(later).withColumn("removed", F.lit(False)).select(*VERSION_SCHEMA.names)
    attempt.write(rows, attempt.tables.registry)


def keep_generation(spark: SparkSession, tables: Tables, every: int = COMMITS_PER_GENERATION) -> None:
    """Write all current bindings as one generation where ``every`` commits came after the last."""
    base = newest_commit(spark, tables, _GENERATION)
    if read_commits(spark, tables).filter(F.col("seq") > (base.seq if base else 0)).count() < every:
        return
    attempt = Attempt.begin(spark, tables, _GENERATION)
    attempt.write(registry_as_of(spark, tables).withColumn("removed", F.lit(False)), tables.registry)
    attempt.commit()
