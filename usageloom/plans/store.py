"""A store of plain Parquet tables: folders, attempts and the commits that make them visible.

Every write of a run goes to a fresh ``attempt=…`` folder, and one commit row
makes all folders of the attempt visible at once. One writer per store at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.model import DEVICE, LOCAL_EVENT_COLUMNS, TEAM_EVENT_COLUMNS, TOKENS
from usageloom.sources.facts import year_month


@dataclass(frozen=True)
class Tables:
    """Where a store keeps its tables."""

    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def uploads(self) -> str:
        return f"{self.root}/uploads"

    @property
    def results(self) -> str:
        return f"{self.root}/results"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def session_days(self) -> str:
        return f"{self.root}/session_days"

    @property
    def session_calls(self) -> str:
        return f"{self.root}/session_calls"

    @property
    def registry(self) -> str:
        return f"{self.root}/registry"

    @property
    def outbox(self) -> str:
        return f"{self.root}/outbox"

    @property
    def reached(self) -> str:
        return f"{self.root}/reached"

    @property
    def replies(self) -> str:
        return f"{self.root}/replies"

    @property
    def cursors(self) -> str:
        return f"{self.root}/cursors"

    @property
    def keys(self) -> str:
        return f"{self.root}/keys"

    @property
    def generations(self) -> str:
        return f"{self.root}/generations"

    @property
    def leases(self) -> str:
        return f"{self.root}/leases"

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"


_TYPES = {
    "event_ts": T.TimestampType(),
    "received_at": T.TimestampType(),
    "local_date": T.DateType(),
    "line_number": T.LongType(),
    **{t: T.LongType() for t in TOKENS},
}


def _event_schema(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])


TEAM_SCHEMA = _event_schema(TEAM_EVENT_COLUMNS)
LOCAL_SCHEMA = _event_schema(LOCAL_EVENT_COLUMNS)
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("last_line", T.LongType()),
        T.StructField("last_event_ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("scanned_at", T.TimestampType()),
    ]
)
UPLOAD_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in DEVICE],
        T.StructField("upload_date", T.DateType()),
        T.StructField("upload_time", T.TimestampType()),
        *[T.StructField(c, T.LongType()) for c in ("event_count", "accepted", "duplicate", "rejected")],
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("attempt", T.StringType()),
    ]
)
ATTEMPT = [T.StructField("attempt", T.StringType())]
MONTH = [T.StructField("year_month", T.IntegerType())]
#: Where a generation finds each month of the events.
GENERATION_SCHEMA = T.StructType([*MONTH, *ATTEMPT])
#: Runs that write derived tables.
GENERATION_RUN, KEY_RUN, SESSION_RUN = "generation", "key table", "session summary"


def existing(spark: SparkSession, path: str, schema: T.StructType, below: str = "") -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path + below)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_commits(spark: SparkSession, tables: Tables) -> DataFrame:
    """(run_id, seq, attempt) of every finished attempt; seq is the order of commits."""
    return existing(spark, tables.commits, COMMIT_SCHEMA)


def read_runs(spark: SparkSession, path: str, schema: T.StructType, monthly: bool = True) -> DataFrame:
    """A table's rows, with the place ``seq`` of the commit that holds them.

    They are those of the newest generation and of the attempts committed after
    it; no other folder is listed.
    """
    tables = Tables(path.rsplit("/", 1)[0])
    base = newest_commit(spark, tables, GENERATION_RUN)
    rows = committed_since(spark, path, schema, base.seq if base else 0, None if monthly else [])
    if base and path == tables.events:
        rows = month_rows(spark, tables, schema, generation_months(spark, tables, base), base.seq).unionByName(rows)
    elif base:
        old = existing(spark, path, T.StructType(schema.fields + ATTEMPT), f"/attempt={base.attempt}")
        rows = old.withColumn("seq", F.lit(base.seq).cast("bigint")).unionByName(rows)
    return rows.drop("attempt")


def generation_months(spark: SparkSession, tables: Tables, base: Row) -> dict[int | None, str]:
    """The attempt that holds each month of the events in a generation."""
    rows = spark.read.schema(GENERATION_SCHEMA).parquet(f"{tables.generations}/attempt={base.attempt}")
    return {r.year_month: r.attempt for r in rows.collect()}


def month_folder(month: int | None) -> str:
    return f"year_month={'__HIVE_DEFAULT_PARTITION__' if month is None else month}"


def month_rows(
    spark: SparkSession, tables: Tables, schema: T.StructType, months: dict[int | None, str], seq: int
) -> DataFrame:
    """Events of the named months, each from its attempt's folder alone."""
    full = T.StructType(schema.fields + ATTEMPT + MONTH)
    paths = [f"{tables.events}/attempt={attempt}/{month_folder(month)}" for month, attempt in months.items()]
    rows = spark.read.schema(full).option("basePath", tables.events).parquet(*paths) if paths else spark.createDataFrame([], full)
    return rows.withColumn("seq", F.lit(seq).cast("bigint"))


def newest_commit(spark: SparkSession, tables: Tables, run_id: str, until: int | None = None) -> Row | None:
    """The newest commit of a derived table, up to a commit: it covers all commits before it."""
    made = read_commits(spark, tables).filter(F.col("run_id") == run_id)
    return (made if until is None else made.filter(F.col("seq") <= until)).orderBy(F.desc("seq")).first()


def committed_since(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    seq: int,
    folders: list[T.StructField] | None = None,
    until: int | None = None,
    without: str | None = None,
) -> DataFrame:
    """A table's rows from attempts committed after ``seq``, up to ``until``, with their place ``seq``.

    No other folder is listed. The commits are few: tables are merged into
    generations, and reading starts at the newest. Attempts of the run ``without``
    are left out.
    """
    later = read_commits(spark, Tables(path.rsplit("/", 1)[0])).filter(F.col("seq") > seq)
    if without is not None:
        later = later.filter(F.col("run_id") != without)
    if until is not None:
        later = later.filter(F.col("seq") <= until)
    found = later.select("attempt", "seq").collect()
    names = [r.attempt for r in found]
    full = T.StructType(schema.fields + ATTEMPT + (MONTH if folders is None else folders))
    placed = T.StructType([*full.fields, T.StructField("seq", T.LongType())])
    if not names:
        return spark.createDataFrame([], placed)
    places = F.create_map(*[F.lit(x) for r in found for x in (r.attempt, r.seq)])
    rows = existing(spark, path, full, "/attempt={" + ",".join(sorted(names)) + "}")
    return rows.withColumn("seq", places[F.col("attempt")])


@dataclass(frozen=True)
class Attempt:
    """The folders of one try of a run; nothing is visible before ``commit``."""

    spark: SparkSession
    tables: Tables
    run_id: str
    name: str

    @staticmethod
    def begin(spark: SparkSession, tables: Tables, run_id: int | str) -> Attempt:
        return Attempt(spark, tables, str(run_id), uuid.uuid4().hex)

    def folder(self, path: str) -> str:
        return f"{path}/attempt={self.name}"

    def write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(self.folder(path))
        return self.spark.read.schema(df.schema).parquet(self.folder(path))

    def write_events(self, events: DataFrame) -> DataFrame:
        folder = self.folder(self.tables.events)
        (
            events.withColumn("year_month", year_month(F.col("local_date")))
            .sortWithinPartitions("year_month", "event_ts")
            .write.partitionBy("year_month")
            .parquet(folder)
        )
        schema = T.StructType(events.schema.fields + MONTH)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)

    def commit(self) -> int:
        """Make the attempt visible; returns its place among the commits."""
        last = read_commits(self.spark, self.tables).agg(F.max("seq")).first()[0]
        row = self.spark.createDataFrame([(self.run_id, (last or 0) + 1)], "run_id string, seq bigint")
        row.coalesce(1).write.parquet(self.folder(self.tables.commits))
        return (last or 0) + 1
