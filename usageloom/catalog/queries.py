"""Registered queries over the test tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.catalog import derive as d
from usageloom.catalog import oracle as o
from usageloom.functions import measures
from usageloom.functions.instants import canonical_instant, local_date
from usageloom.functions.keys import snapshot_event_key
from usageloom.functions.texts import (
    has_positive_usage,
    is_known_model,
    is_known_tool,
    short_hash,
)
from usageloom.model import DEVICE, LOCAL, TEAM, TOKENS
from usageloom.operators import decode, gate, idempotent, outbox, rank, registry, rollup, team_ingest
from usageloom.operators.grains import Grains
from usageloom.operators.series import carry_along
from usageloom.plans import collector, documents, generations, jobs, local_reports, periods, registry_store, sessions, team_reports
from usageloom.session import scratch_dir
from usageloom.sources import envelopes as env
from usageloom.sources import facts, lines, message_log, snapshot_log
from usageloom.streaming import ingest as stream_ingest
from usageloom.streaming import running
from usageloom.streaming.closing_days import ClosingDays

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPAN = periods.resolve_range(d.AS_OF, month="2024-01")
WEEK = periods.resolve_period("week", d.AS_OF)
MONTH = periods.resolve_period("month", d.AS_OF)


def plain(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times and maps or arrays as text, for comparison."""
    columns = []
    for field in df.schema:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.TimestampType):
            name = f"CAST({name} AS timestamp_ntz) AS {name}"
        elif isinstance(field.dataType, T.MapType):
            pairs = f"transform(map_entries({name}), e -> concat(e.key, ':', e.value))"
            name = f"array_join({pairs}, ',') AS {name}"
        elif isinstance(field.dataType, T.ArrayType):
            name = f"array_join({name}, ',') AS {name}"
        columns.append(name)
    return df.selectExpr(*columns)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle where there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_SPINE_DAYS = "spine AS (SELECT CAST(range AS DATE) AS local_date FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY))"


def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.in_range(d.usage(spark, sf_dir), SPAN.start, SPAN.end, d.ZONE)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.registry(d.usage_base(spark, sf_dir))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.uploads(d.usage_base(spark, sf_dir))


# --- sources -----------------------------------------------------------------


@query("SELECT event_id, user_id, 0::BIGINT AS line_drift FROM events")
def session_lines(spark, sf_dir):
    """Write events as log files, read them back: every line number must match."""
    d.configure(spark)
    path = scratch_dir(spark, "lines")
    raw = spark.read.schema(d.EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    text = raw.select("event_id", "user_id", row.alias("row")).select(
        F.to_json(F.struct("event_id", "user_id", "row")).alias("value")
    )
    text.write.option("lineSep", "\n").text(f"{path}/raw")
    # The text sink names its files .txt; the glob of the reader is for logs.
    _as_logs(spark, f"{path}/raw")
    read = lines.session_lines(spark, path)
    parsed = F.from_json("line", "event_id bigint, user_id bigint, row bigint").alias("r")
    return read.select("line_no", parsed).select(
        "r.event_id", "r.user_id", (F.col("line_no") - 1 - F.col("r.row")).alias("line_drift")
    )


def _as_logs(spark: SparkSession, path: str) -> None:
    """Give the files of a folder the log suffix, through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".jsonl"))


_TOKEN_LINES = "event_id%13 = 0 AND event_id%17 <> 0"


@query(
    o.with_(o.BASE, o.SNAPSHOTS)
    + f"""SELECT path, line_no*2 AS line_no, 'token_count' AS kind, CAST(NULL AS VARCHAR) AS context_model,
  CASE WHEN event_id%13<>0 THEN event_ts END AS event_ts,
  CASE WHEN event_id%13=0 THEN 'parse error: DateTimeParseException' END AS error,
  {", ".join(f"CASE WHEN event_id%13<>0 THEN {t} END AS {t}" for t in TOKENS)}
FROM snapshots WHERE event_id%17<>0
UNION ALL
SELECT path, line_no*2-1, 'turn_context', context_model, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM snapshots WHERE context_model IS NOT NULL"""
)
def snapshot_log_records(spark, sf_dir):
    records = snapshot_log.snapshot_log_records(d.snapshot_lines(spark, sf_dir))
    return records.select(
        "path", "line_no", "kind", "context_model", "event_ts", "error",
        *[F.col(f"cumulative.{t}").alias(t) for t in TOKENS],
    )


_MESSAGE_ROWS = """rows_ AS (SELECT *, '/messages/'||user_id||'.jsonl' AS path,
    row_number() OVER (PARTITION BY uid ORDER BY event_ts, event_id) AS line_no,
    CASE WHEN event_id%3=2 THEN input_tokens ELSE input_tokens+k+cached_input_tokens END AS g,
    CASE WHEN event_id%3=2 THEN cached_input_tokens ELSE k+cached_input_tokens END AS c
  FROM replayed),
seen AS (SELECT *, g+output_tokens+reasoning_output_tokens AS t, event_id%19=0 AS failed
  FROM rows_),
used AS (SELECT * FROM seen WHERE NOT failed AND (g>0 OR c>0 OR output_tokens>0 OR reasoning_output_tokens>0)),
known AS (SELECT path, first(model ORDER BY line_no) AS first_known FROM rows_ WHERE model<>'unknown' GROUP BY path),
events_ AS (SELECT used.* REPLACE (CASE WHEN model='unknown' THEN coalesce(first_known,'unknown') ELSE model END AS model),
    strftime(event_ts,'%Y-%m-%dT%H:%M:%S')||
      CASE WHEN epoch_us(event_ts)%1000000=0 THEN ''
           WHEN epoch_us(event_ts)%1000=0 THEN '.'||lpad((epoch_us(event_ts)%1000000//1000)::VARCHAR,3,'0')
           ELSE '.'||lpad((epoch_us(event_ts)%1000000)::VARCHAR,6,'0') END||'Z' AS instant
  FROM used LEFT JOIN known USING (path)),
keyed AS (SELECT *, 'claude-code|local_jsonl|'||session_id||'|'||
    left(sha256(CASE event_id%3 WHEN 0 THEN 'msg-'||event_id WHEN 1 THEN 'u-'||event_id ELSE instant END),16)
    ||'|'||model||'|'||left(sha256(g||'|'||c||'|'||output_tokens||'|'||reasoning_output_tokens||'|'||t),16) AS message_key
  FROM events_)"""

_MESSAGE = o.with_(o.BASE, o.REPLAYED, _MESSAGE_ROWS)
_MESSAGE_TOKENS = (
    "g AS input_tokens, c AS cached_input_tokens, output_tokens, reasoning_output_tokens, "
    "t AS total_tokens"
)


@query(
    _MESSAGE
    + """SELECT path, count(*) FILTER (failed) AS dropped_lines,
  count(*) FILTER (NOT failed AND event_id%3=0 AND (g>0 OR c>0 OR output_tokens>0)) AS message_rows,
  count(*) FILTER (NOT failed AND event_id%3=1 AND (g>0 OR c>0 OR output_tokens>0)) AS tool_result_rows,
  count(*) FILTER (NOT failed AND event_id%3=2 AND (g>0 OR c>0 OR output_tokens>0)) AS flat_rows,
  coalesce(sum(t) FILTER (NOT failed),0)::BIGINT AS total_tokens
FROM seen GROUP BY path"""
)
def message_log_records(spark, sf_dir):
    records = message_log.message_log_records(d.message_lines(spark, sf_dir))
    shapes = [
        F.count_if(F.coalesce(F.col("shape") == s, F.lit(False))).alias(f"{s}_rows")
        for s in ("message", "tool_result", "flat")
    ]
    return records.groupBy("path").agg(
        F.count_if(F.coalesce("dropped", F.lit(False))).alias("dropped_lines"),
        *shapes,
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )


@query(
    o.with_(o.BASE, o.REPLAYED, _MESSAGE_ROWS)
    + f"""SELECT session_id, {_MESSAGE_TOKENS}, source_kind, source_quality FROM used,
  (VALUES ('local_jsonl','reported'),('otel_metric','reported'),('hook_metadata','estimated'),('fixture','reported')) m(source_kind, source_quality)"""
    .replace("t AS total_tokens, source_kind, source_quality", "t AS total_tokens, m.source_kind, m.source_quality")
)
def usage_telemetry(spark, sf_dir):
    """Message logs written as files and read in each of the four modes."""
    logs = scratch_dir(spark, "telemetry")
    d.message_lines(spark, sf_dir).select(F.col("line").alias("value")).write.text(f"{logs}/raw")
    _as_logs(spark, f"{logs}/raw")
    read = [message_log.usage_telemetry(spark, logs, mode) for mode in message_log.SOURCE_MODES]
    whole = read[0]
    for part in read[1:]:
        whole = whole.unionByName(part)
    return whole.filter(F.col("shape") != "failed").select("session_id", *TOKENS, "source_kind", "source_quality")


@query(
    o.with_(o.BASE)
    + """SELECT mode, source_kind, source_quality, count(*) AS events FROM base,
  (VALUES ('local','local_jsonl','reported'),('otel','otel_metric','reported'),
          ('hook','hook_metadata','estimated'),('fixture','fixture','reported'),
          ('snapshot','local_jsonl','derived')) m(mode, kind, quality)
  , LATERAL (SELECT kind AS source_kind, quality AS source_quality) t
GROUP BY ALL""".replace("source_kind, source_quality, count", "t.source_kind, t.source_quality, count")
)
def tag_source(spark, sf_dir):
    base = d.usage_base(spark, sf_dir).select("event_key")
    tagged = None
    for mode in (*message_log.SOURCE_MODES, "snapshot"):
        part = message_log.tag_source(base.withColumn("mode", F.lit(mode)), mode)
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("mode", "source_kind", "source_quality").agg(F.count("*").alias("events"))


_ENVELOPE_ROWS = """sent AS (SELECT *, device_id||'/'||local_date AS envelope_id, device_id||'-token' AS token,
    CASE WHEN uid%19=0 THEN 'intruder' ELSE user_id END AS client_user_id,
    max(event_ts) OVER (PARTITION BY device_id, local_date) AS uploaded_at,
    row_number() OVER (PARTITION BY device_id, local_date ORDER BY event_ts, event_id)-1 AS position
  FROM replayed)"""
_SENT = (o.BASE, o.REPLAYED, _ENVELOPE_ROWS)


@query(
    o.with_(*_SENT)
    + "SELECT envelope_id, client_user_id, device_id AS client_device_id, position, event_key FROM sent"
)
def upload_envelopes(spark, sf_dir):
    opened = env.open_envelopes(d.envelopes(d.usage_base(spark, sf_dir)))
    return env.envelope_events(opened).select(
        "envelope_id", "client_user_id", "client_device_id", F.col("position").cast("bigint").alias("position"),
        F.get_json_object("event_text", "$.event_key").alias("event_key"),
    )


@query(
    o.with_(*_SENT)
    + """SELECT count(DISTINCT envelope_id) OVER () AS envelopes, token, client_user_id, uploaded_at, position, event_key FROM sent"""
)
def read_envelopes(spark, sf_dir):
    """A drop of JSON lines, one envelope each, with an id by hash; a repeated file gives the same ids."""
    d.configure(spark)
    drop = scratch_dir(spark, "drop")
    sent = d.envelopes(d.usage_base(spark, sf_dir)).select("token", canonical_instant(F.col("uploaded_at")).alias("uploaded_at"), "body")
    sent.write.json(f"{drop}/first")
    read = env.read_envelopes(spark, f"{drop}/first")
    again = env.read_envelopes(spark, [f"{drop}/first", f"{drop}/first"]).select("envelope_id").distinct()
    ids = again.agg(F.count("*").alias("envelopes"))
    events = env.envelope_events(env.open_envelopes(read)).select(
        "token", "client_user_id", "uploaded_at", F.col("position").cast("bigint").alias("position"),
        F.get_json_object("event_text", "$.event_key").alias("event_key"),
    )
    return events.select(ids.scalar().alias("envelopes"), "*")


@query(
    o.with_(o.BASE, o.DEC)
    + f"""SELECT event_key, tool, session_id, event_ts, local_date, year(local_date)*100+month(local_date) AS year_month,
  {", ".join(TOKENS)} FROM moved WHERE {o.MONTH}"""
)
def read_usage(spark, sf_dir):
    """One month of a fact that holds several."""
    path = scratch_dir(spark, "fact")
    facts.write_usage_by_month(d.team_events(d.usage_dec(d.usage_base(spark, sf_dir))), path)
    read = facts.read_usage(spark, path, SPAN.start, SPAN.end, d.ZONE)
    return read.select(
        "event_key", "tool", "session_id", "event_ts", "local_date",
        F.col("year_month").cast("bigint").alias("year_month"), *TOKENS,
    )


@query(
    o.with_(o.BASE, o.DEC)
    + """SELECT year(local_date)*100+month(local_date) AS year_month, count(*) AS events,
  sum(total_tokens)::BIGINT AS total_tokens FROM moved GROUP BY 1"""
)
def write_usage_by_month(spark, sf_dir):
    path = scratch_dir(spark, "fact")
    facts.write_usage_by_month(d.team_events(d.usage_dec(d.usage_base(spark, sf_dir))), path)
    return spark.read.parquet(path).groupBy(F.col("year_month").cast("bigint").alias("year_month")).agg(
        F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens")
    )


@query(
    o.with_(o.BASE, o.UPLOADS)
    + "SELECT * FROM uploads WHERE upload_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-17'"
)
def read_uploads(spark, sf_dir):
    last = periods.resolve_range(d.AS_OF, days=7)
    return facts.read_uploads(_uploads(spark, sf_dir), last.start, last.end)


# --- decoding ----------------------------------------------------------------

# Raw snapshot lines: model lines, broken JSON (event_id%17) and bad times (%13).
_VALID = "valid AS (SELECT * FROM snapshots WHERE event_id%17<>0 AND event_id%13<>0)"
_SNAPSHOT_MODEL = """models AS (SELECT *, last_value(context_model IGNORE NULLS) OVER (
      PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS carried,
    first_value(CASE WHEN context_model<>'unknown' THEN context_model END IGNORE NULLS) OVER (
      PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_known
  FROM snapshots)"""
_FILLED = "CASE WHEN coalesce(carried,'unknown')='unknown' THEN coalesce(first_known,'unknown') ELSE carried END"
_SNAPSHOT_EVENTS = f"""file_models AS (SELECT event_id, copy, {_FILLED} AS filled FROM models),
snapshot_events AS (SELECT 'codex|'||session_id||'|'||left(sha256(path),16)||'|'||line_no*2||'|'||total_tokens||'|'
      ||input_tokens||'|'||output_tokens AS event_key, session_id, filled AS model, event_ts,
    CAST(event_ts + INTERVAL 8 HOUR AS DATE) AS local_date, path, line_no*2 AS line_no,
    {", ".join(f"d_{t} AS {t}" for t in TOKENS)}
  FROM deltas JOIN file_models USING (event_id, copy) WHERE {o.POSITIVE_DELTA})"""
_SNAPSHOT_CHAIN = (o.BASE, o.SNAPSHOTS, _VALID, o.delta_sql("valid"), _SNAPSHOT_MODEL, _SNAPSHOT_EVENTS)


def _snapshot_events(spark, sf_dir):
    records = snapshot_log.snapshot_log_records(d.snapshot_lines(spark, sf_dir))
    return decode.snapshot_events(records, d.ZONE)


def _message_events(spark, sf_dir):
    records = message_log.message_log_records(d.message_lines(spark, sf_dir))
    return decode.message_events(records, d.ZONE)


_MESSAGE_FIRST = """firsts AS (SELECT *, row_number() OVER (PARTITION BY message_key ORDER BY path, line_no) AS nth FROM keyed)"""


@query(
    o.with_(*_SNAPSHOT_CHAIN, o.REPLAYED, _MESSAGE_ROWS, _MESSAGE_FIRST)
    + f"""SELECT event_key, 'codex' AS tool, session_id, model, event_ts, local_date, {", ".join(TOKENS)},
  'local_jsonl' AS source_kind, 'derived' AS source_quality FROM snapshot_events WHERE {o.MONTH}
UNION ALL SELECT message_key, 'claude-code', session_id, model, event_ts, local_date,
  g, c, output_tokens, reasoning_output_tokens, t, 'local_jsonl', 'reported' FROM firsts WHERE nth=1 AND {o.MONTH}"""
)
def all_tool_events(spark, sf_dir):
    both = decode.all_tool_events(
        _snapshot_events(spark, sf_dir), _message_events(spark, sf_dir), SPAN.start, SPAN.end
    )
    return both.drop("source_path", "line_number")


def _carried(spark, sf_dir):
    return decode.carry_context(d.snapshot_records(spark, sf_dir))


@query(
    o.with_(o.BASE, o.SNAPSHOTS)
    + """SELECT path, line_no, coalesce(last_value(CASE WHEN event_id%4=0 THEN 'announced-'||event_id END IGNORE NULLS)
    OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), session_id) AS session_id FROM snapshots"""
)
def carry_session(spark, sf_dir):
    announced = F.when(
        F.col("event_id") % 4 == 0, F.concat(F.lit("announced-"), F.col("event_id").cast("string"))
    )
    records = d.snapshot_records(spark, sf_dir).withColumn("session_meta_id", announced)
    return decode.carry_context(records).select("path", "line_no", "session_id")


@query(
    o.with_(o.BASE, o.SNAPSHOTS, _SNAPSHOT_MODEL)
    + "SELECT path, line_no, coalesce(carried,'unknown') AS model FROM models"
)
def carry_model(spark, sf_dir):
    rows = d.snapshot_records(spark, sf_dir).select("path", "line_no", "context_model")
    carried = carry_along(rows, "path", "line_no", last=("context_model",))
    return carried.select(
        "path", "line_no", F.coalesce("last_context_model", F.lit("unknown")).alias("model")
    )


@query(
    o.with_(o.BASE, o.SNAPSHOTS, o.delta_sql("snapshots"))
    + f"""SELECT path, line_no, {", ".join(f"d_{t} AS {t}" for t in TOKENS)} FROM deltas WHERE {o.POSITIVE_DELTA}"""
)
def cumulative_to_delta(spark, sf_dir):
    return decode.cumulative_to_delta(_carried(spark, sf_dir)).select("path", "line_no", *TOKENS)


@query(
    o.with_(o.BASE, o.SNAPSHOTS, o.delta_sql("snapshots"))
    + f"""SELECT path, line_no, {", ".join(f"d_{t} AS {t}" for t in TOKENS)} FROM deltas WHERE {o.POSITIVE_DELTA}"""
)
def cumulative_to_delta_in_segments(spark, sf_dir):
    """The same, with files cut every three lines: state must cross segments."""
    carried = decode.carry_context(d.snapshot_records(spark, sf_dir), segment_rows=3)
    return decode.cumulative_to_delta(carried).select("path", "line_no", *TOKENS)


@query(
    o.with_(o.BASE, o.SNAPSHOTS, _SNAPSHOT_MODEL) + f"SELECT path, line_no, {_FILLED} AS model FROM models"
)
def backfill_model(spark, sf_dir):
    return _carried(spark, sf_dir).select("path", "line_no", "model")


@query(
    o.with_(*_SNAPSHOT_CHAIN)
    + f"""SELECT event_key, session_id, model, event_ts, local_date, path AS source_path, line_no AS line_number,
  {", ".join(TOKENS)} FROM snapshot_events"""
)
def snapshot_events(spark, sf_dir):
    """The whole snapshot-log pipeline, raw lines to events."""
    return _snapshot_events(spark, sf_dir).select(
        "event_key", "session_id", "model", "event_ts", "local_date", "source_path", "line_number", *TOKENS
    )


@query(
    _MESSAGE[:-1] + ",\n" + _MESSAGE_FIRST
    + f"""
SELECT message_key AS event_key, session_id, model, event_ts, local_date, path AS source_path,
  line_no AS line_number, {_MESSAGE_TOKENS} FROM firsts WHERE nth=1"""
)
def message_events(spark, sf_dir):
    """The whole message-log pipeline: shapes, backfill, keys, first row per key."""
    return _message_events(spark, sf_dir).select(
        "event_key", "session_id", "model", "event_ts", "local_date", "source_path", "line_number", *TOKENS
    )


@query(
    _MESSAGE
    + """SELECT split_part(message_key,'|',5) AS key_model, count(DISTINCT message_key) AS event_keys
FROM keyed GROUP BY 1"""
)
def rekey_after_backfill(spark, sf_dir):
    parts = F.split("event_key", r"\|")
    return (
        _message_events(spark, sf_dir)
        .groupBy(parts[4].alias("key_model"))
        .agg(F.count("*").alias("event_keys"))
    )


@query(
    o.with_(o.BASE, o.SNAPSHOTS)
    + """SELECT path, line_no, 'codex|'||session_id||'|'||left(sha256(path),16)||'|'||line_no||'|'||total_tokens||'|'
  ||input_tokens||'|'||output_tokens AS event_key FROM snapshots"""
)
def snapshot_key(spark, sf_dir):
    rows = d.snapshots(spark, sf_dir)
    key = snapshot_event_key(F.col("session_id"), F.col("path"), F.col("line_no"), F.col("cumulative"))
    return rows.select("path", "line_no", key.alias("event_key"))


@query(_MESSAGE + "SELECT DISTINCT message_key AS event_key FROM keyed")
def message_key(spark, sf_dir):
    return _message_events(spark, sf_dir).select("event_key")


@query(
    o.with_(o.BASE, o.REPLAYED)
    + """SELECT event_key, copy, total_tokens FROM (SELECT *, row_number() OVER (
  PARTITION BY event_key ORDER BY copy) AS nth FROM replayed) WHERE nth=1"""
)
def dedupe_first(spark, sf_dir):
    base = d.usage_base(spark, sf_dir).withColumn("copy", F.lit(0))
    twice = base.unionByName(base.filter(F.col("event_id") % 20 == 0).withColumn("copy", F.lit(1)))
    rows = twice.select("event_key", "copy", "total_tokens")
    return idempotent.first_per_key(rows, ("event_key",), ("copy",))


@query(
    o.with_(o.BASE)
    + """SELECT event_key, input_tokens+k+cached_input_tokens AS input_tokens,
  k+cached_input_tokens AS cached_input_tokens, output_tokens, reasoning_output_tokens,
  CASE WHEN event_id%2=0 THEN total_tokens
       ELSE input_tokens+k+cached_input_tokens+output_tokens+reasoning_output_tokens END AS total_tokens FROM base"""
)
def message_token_normalise(spark, sf_dir):
    raw = {
        "input_tokens": F.col("input_tokens"),
        "cache_creation_input_tokens": F.col("k"),
        "cache_read_input_tokens": F.col("cached_input_tokens"),
        "output_tokens": F.col("output_tokens"),
        "reasoning_output_tokens": F.col("reasoning_output_tokens"),
        "total_tokens": F.when(F.col("event_id") % 2 == 0, F.col("total_tokens")),
    }
    counters = message_log.message_token_normalise(raw)
    return d.usage_base(spark, sf_dir).select(
        "event_key", *[c.alias(t) for c, t in zip(counters, TOKENS)]
    )


@query(
    o.with_(o.BASE, o.SNAPSHOTS)
    + f"""SELECT path, line_no*2 AS line, 'parse error: DateTimeParseException' AS message
FROM snapshots WHERE {_TOKEN_LINES}"""
)
def decode_errors(spark, sf_dir):
    return decode.decode_errors(
        snapshot_log.snapshot_log_records(d.snapshot_lines(spark, sf_dir))
    )


@query(
    """SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS shanghai, CAST(ts AS DATE) AS utc,
  CAST(ts - INTERVAL 5 HOUR AS DATE) AS new_york FROM events"""
)
def local_date_in_zones(spark, sf_dir):
    d.configure(spark)
    ts = F.col("ts").cast("timestamp")
    return spark.read.schema(d.EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        local_date(ts, d.ZONE).alias("shanghai"),
        local_date(ts, "UTC").alias("utc"),
        local_date(ts, "America/New_York").alias("new_york"),
    )


@query(
    """SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S')||
  CASE WHEN epoch_us(ts)%1000000=0 THEN '' WHEN epoch_us(ts)%1000=0
    THEN '.'||lpad((epoch_us(ts)%1000000//1000)::VARCHAR,3,'0')
    ELSE '.'||lpad((epoch_us(ts)%1000000)::VARCHAR,6,'0') END||'Z' AS instant,
  left(sha256(props),16) AS short_hash FROM events"""
)
def scalar_keys(spark, sf_dir):
    d.configure(spark)
    return spark.read.schema(d.EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        canonical_instant(F.col("ts").cast("timestamp")).alias("instant"),
        short_hash(F.col("props")).alias("short_hash"),
    )


# --- ingest ------------------------------------------------------------------

_MANIFESTS = """files AS (SELECT tool, '/logs/'||session_id AS path, sum(total_tokens)::BIGINT AS size_bytes,
    max(event_ts) AS modified_at, count(*) AS last_line, max(event_ts) AS scanned_at FROM base GROUP BY 1,2),
old_files AS (SELECT tool, '/logs/'||session_id AS path, sum(total_tokens)::BIGINT AS size_bytes,
    max(event_ts) AS modified_at, count(*) AS last_line, max(event_ts) AS scanned_at
  FROM base WHERE event_ts < TIMESTAMP '2024-01-20' GROUP BY 1,2)"""


@query(
    o.with_(o.BASE, _MANIFESTS)
    + """SELECT f.tool, f.path, f.size_bytes, f.modified_at FROM files f WHERE NOT EXISTS (
  SELECT 1 FROM old_files x WHERE x.tool=f.tool AND x.path=f.path AND x.size_bytes=f.size_bytes
    AND x.modified_at=f.modified_at)"""
)
def changed_files(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    return idempotent.changed_files(d.manifest(base), d.old_manifest(base)).select(
        "tool", "path", "size_bytes", "modified_at"
    )


@query(
    o.with_(o.BASE, _MANIFESTS)
    + "SELECT * FROM files"
)
def upsert_manifest(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    new = d.manifest(base)
    changed = idempotent.changed_files(new, d.old_manifest(base))
    return idempotent.upsert_manifest(d.old_manifest(base), changed)


@query(
    o.with_(o.BASE)
    + "SELECT event_key, tool, event_ts, total_tokens FROM base WHERE event_ts >= TIMESTAMP '2024-01-20'"
)
def insert_new_events(spark, sf_dir):
    """A replayed batch against the store of earlier events: only new keys remain."""
    base = d.usage_base(spark, sf_dir).select("event_key", "tool", "event_ts", "total_tokens", "event_id")
    stored = base.filter(F.col("event_ts") < F.lit("2024-01-20").cast("timestamp"))
    fresh = idempotent.insert_new_events(
        d.usage_replayed(base), stored, ("event_key",), ("event_ts", "event_id")
    )
    return fresh.drop("event_id")


@query(
    o.with_(o.BASE, o.REPLAYED)
    + """SELECT count(DISTINCT event_key) FILTER (event_ts >= TIMESTAMP '2024-01-20') AS events_inserted,
  count(*) - count(DISTINCT event_key) FILTER (event_ts >= TIMESTAMP '2024-01-20') AS events_skipped FROM replayed"""
)
def insert_counts(spark, sf_dir):
    base = d.usage_base(spark, sf_dir).select("event_key", "event_ts", "event_id")
    batch = d.usage_replayed(base)
    stored = base.filter(F.col("event_ts") < F.lit("2024-01-20").cast("timestamp"))
    fresh = idempotent.insert_new_events(batch, stored, ("event_key",), ("event_ts", "event_id"))
    return idempotent.insert_counts(batch, fresh)


_CODE = """CASE WHEN r.token_hash IS NULL THEN 'unauthorized' WHEN r.status<>'active' THEN 'forbidden'
  WHEN s.client_user_id<>r.user_id THEN 'identity_conflict' ELSE 'ok' END"""
_CHECKED = f"""heads AS (SELECT DISTINCT envelope_id, token, client_user_id, device_id, uploaded_at FROM sent),
checked AS (SELECT s.envelope_id, s.uploaded_at, sha256(s.token) AS token_hash, r.team_id, r.user_id, r.device_id,
    {_CODE} AS code FROM heads s LEFT JOIN registry r ON r.token_hash=sha256(s.token))"""
_CHECK_CHAIN = (*_SENT, o.REGISTRY, _CHECKED)


def _checked(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    return team_ingest.check_envelopes(d.envelopes(base), d.registry(base))


@query(
    o.with_(*_CHECK_CHAIN)
    + "SELECT envelope_id, token_hash, team_id, user_id, device_id, code FROM checked"
)
def resolve_device(spark, sf_dir):
    """Envelope guards in order: token, status, identity."""
    return _checked(spark, sf_dir).select(
        "envelope_id", "token_hash", *[F.col(f"bound_{c}").alias(c) for c in DEVICE], "code"
    )


@query(
    o.with_(*_CHECK_CHAIN)
    + "SELECT code, count(*) AS envelopes FROM checked GROUP BY code"
)
def identity_conflict(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy("code").agg(F.count("*").alias("envelopes"))


_BODY = "CASE WHEN doc_id%100=0 THEN repeat(text, 1 + CAST(floor(1048576/length(text)) AS INT)) ELSE text END"


@query(
    f"""SELECT doc_id, length(body) > 1048576 AS too_long,
  CASE WHEN length(body) > 1048576 THEN 'payload_too_large' ELSE 'unauthorized' END AS code
FROM (SELECT doc_id, {_BODY} AS body FROM documents)"""
)
def envelope_limits(spark, sf_dir):
    """The size guard comes before the token guard, on every document text, some over-long."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select("doc_id", F.expr(_BODY).alias("body"))
    opened = env.open_envelopes(
        texts.select(
            "doc_id",
            "body",
            F.lit("").alias("token"),
            F.lit(None).cast("string").alias("bound_user_id"),
            F.lit(None).cast("string").alias("bound_device_id"),
            F.lit(None).cast("string").alias("bound_status"),
            gate.too_many_chars(F.col("body")).alias("too_long"),
        )
    )
    return opened.select("doc_id", "too_long", gate.envelope_code().alias("code"))


_REASON = """CASE WHEN tool='other' THEN 'unknown_tool' WHEN event_id%23=0 THEN 'forbidden_content'
  WHEN NOT (input_tokens>0 OR cached_input_tokens>0 OR output_tokens>0 OR reasoning_output_tokens>0) THEN 'no_usage' END"""


def _screened(spark, sf_dir):
    opened = env.open_envelopes(d.envelopes(d.usage_base(spark, sf_dir)))
    return gate.screen_events(env.envelope_events(opened))


@query(
    o.with_(*_SENT)
    + f"SELECT envelope_id, position, {_REASON} AS reject_reason FROM sent"
)
def reject_events(spark, sf_dir):
    return _screened(spark, sf_dir).select(
        "envelope_id", F.col("position").cast("bigint").alias("position"), "reject_reason"
    )


@query(
    o.with_(*_SENT)
    + "SELECT envelope_id, position, event_key FROM sent WHERE event_id%23<>0"
)
def privacy_screen(spark, sf_dir):
    rows = _screened(spark, sf_dir).withColumn("position", F.col("position").cast("bigint"))
    return gate.privacy_screen(rows, "event_text", ("envelope_id", "position", "event_key"))


@query(
    o.with_(*_SENT)
    + """SELECT envelope_id, position, model, total_tokens,
  CASE WHEN source_kind='' THEN 'unknown' ELSE source_kind END AS source_kind,
  CASE WHEN source_quality='' THEN 'unknown' ELSE source_quality END AS source_quality FROM sent"""
)
def canonical_defaults(spark, sf_dir):
    return _screened(spark, sf_dir).select(
        "envelope_id", F.col("position").cast("bigint").alias("position"), "model", "total_tokens",
        "source_kind", "source_quality",
    )


_VALID_SENT = f"""valid AS (SELECT s.*, c.team_id AS b_team, c.user_id AS b_user, c.device_id AS b_device
  FROM sent s JOIN checked c USING (envelope_id) WHERE c.code='ok' AND ({_REASON}) IS NULL)"""
_ACCEPTED = """nth AS (SELECT *, row_number() OVER (PARTITION BY b_team, b_user, b_device, event_key
    ORDER BY uploaded_at, envelope_id, position) AS n FROM valid),
accepted AS (SELECT * FROM nth WHERE n=1 AND event_ts >= TIMESTAMP '2024-01-10')"""
_RUN = (*_CHECK_CHAIN, _VALID_SENT, _ACCEPTED)
_RESULTS = """results AS (SELECT c.envelope_id, c.team_id, c.user_id, c.device_id, c.uploaded_at, c.token_hash, c.code,
    coalesce(t.event_count,0) AS event_count, coalesce(a.accepted,0) AS accepted,
    coalesce(t.valid,0)-coalesce(a.accepted,0) AS duplicate, coalesce(t.event_count,0)-coalesce(t.valid,0) AS rejected
  FROM checked c
  LEFT JOIN (SELECT s.envelope_id, count(*) AS event_count, count(v.envelope_id) AS valid FROM sent s
    JOIN checked c2 ON c2.envelope_id=s.envelope_id AND c2.code='ok'
    LEFT JOIN valid v ON v.envelope_id=s.envelope_id AND v.position=s.position GROUP BY 1) t USING (envelope_id)
  LEFT JOIN (SELECT envelope_id, count(*) AS accepted FROM accepted GROUP BY 1) a USING (envelope_id))"""


def _run(spark, sf_dir) -> team_ingest.IngestRun:
    """All envelopes against a store that already holds the events before 10 January."""
    base = d.usage_base(spark, sf_dir)
    before = F.col("event_ts") < F.lit("2024-01-10").cast("timestamp")
    return team_ingest.ingest_team_batch(d.envelopes(base), d.registry(base), d.team_events(base).filter(before), d.ZONE)


@query(
    o.with_(*_RUN)
    + f"""SELECT b_team AS team_id, b_user AS user_id, b_device AS device_id, event_key, tool, session_id, model,
  event_ts, local_date, {", ".join(TOKENS)}, uploaded_at AS received_at FROM accepted"""
)
def attribute_events(spark, sf_dir):
    """New events of the run; team, user and device come from the registry."""
    return _run(spark, sf_dir).new_events.drop("source_kind", "source_quality")


@query(
    o.with_(*_RUN, _RESULTS)
    + "SELECT envelope_id, code, event_count, accepted, duplicate, rejected FROM results"
)
def ingest_team_batch(spark, sf_dir):
    return _run(spark, sf_dir).results.select(
        "envelope_id", "code", "event_count", "accepted", "duplicate", "rejected"
    )


@query(
    o.with_(*_RUN, _RESULTS)
    + """SELECT team_id, user_id, device_id, CAST(uploaded_at + INTERVAL 8 HOUR AS DATE) AS upload_date,
  uploaded_at AS upload_time, event_count, accepted, duplicate, rejected, 'ok' AS status, '' AS message
FROM results WHERE code='ok'"""
)
def append_upload_ledger(spark, sf_dir):
    results = _run(spark, sf_dir).results
    nothing = d.uploads(d.usage_base(spark, sf_dir)).filter(F.lit(False))
    return team_ingest.append_upload_ledger(nothing, results, d.ZONE)


@query(
    o.with_(*_RUN, _RESULTS)
    + """SELECT r.token_hash, r.team_id, r.user_id, r.device_id, m.latest AS last_seen_at FROM registry r
LEFT JOIN (SELECT token_hash, max(uploaded_at) AS latest FROM results WHERE code='ok' GROUP BY 1) m USING (token_hash)"""
)
def touch_last_seen(spark, sf_dir):
    seen = _checked(spark, sf_dir).filter(F.col("code") == "ok")
    touched = registry.touch_last_seen(_registry(spark, sf_dir), seen)
    return touched.select("token_hash", *DEVICE, "last_seen_at")


_TURN = "TIMESTAMP '2024-01-15'"
_UID = "CAST(replace(r.user_id,'user-','') AS BIGINT)"
_LATE_CODE = f"""CASE WHEN r.token_hash IS NULL OR (s.uploaded_at>={_TURN} AND {_UID}%5=3) THEN 'unauthorized'
  WHEN r.status<>'active' OR (s.uploaded_at>={_TURN} AND {_UID}%5=4) THEN 'forbidden'
  WHEN s.client_user_id<>r.user_id THEN 'identity_conflict' ELSE 'ok' END"""
_LATE_CHECKED = _CHECKED.replace(_CODE, _LATE_CODE)


def _revoked_between(spark, sf_dir) -> tuple[jobs.Tables, int]:
    """A team store that ingests, loses some bindings, and ingests again; with the commit before the change."""
    d.configure(spark)
    base = d.usage_base(spark, sf_dir)
    tables = jobs.Tables(scratch_dir(spark, "store"))
    first = registry_store.change_registry(spark, tables, "register", upserts=d.registry(base))
    sent = d.envelopes(base)
    late = F.col("uploaded_at") >= F.lit("2024-01-15").cast("timestamp")
    jobs.run_team_ingest(spark, sent.filter(~late), None, tables, d.ZONE, "early")
    group = F.regexp_replace("user_id", "user-", "").cast("bigint") % 5
    current = registry_store.registry_as_of(spark, tables)
    registry_store.change_registry(
        spark, tables, "revoke", removed=current.filter(group == 3),
        upserts=current.filter(group == 4).withColumn("status", F.lit("disabled")),
    )
    jobs.run_team_ingest(spark, sent.filter(late), None, tables, d.ZONE, "late")
    return tables, first


@query(
    o.with_(*_SENT, o.REGISTRY, _LATE_CHECKED)
    + f"""SELECT 'first' AS as_of, token_hash, status, created_at, last_seen_at FROM registry
UNION ALL SELECT 'now', r.token_hash, CASE WHEN {_UID}%5=4 THEN 'disabled' ELSE r.status END, r.created_at, m.latest
FROM registry r LEFT JOIN (SELECT token_hash, max(uploaded_at) AS latest FROM checked WHERE code='ok' GROUP BY 1) m USING (token_hash)
WHERE {_UID}%5<>3"""
)
def registry_versions(spark, sf_dir):
    """The stored registry as of its first commit and now, after uploads, removals and a change."""
    tables, first = _revoked_between(spark, sf_dir)
    columns = ("token_hash", "status", "created_at", "last_seen_at")
    then = registry_store.registry_as_of(spark, tables, first).select(F.lit("first").alias("as_of"), *columns)
    return then.unionByName(registry_store.registry_as_of(spark, tables).select(F.lit("now").alias("as_of"), *columns))


@query(
    o.with_(*_SENT, o.REGISTRY, _LATE_CHECKED)
    + "SELECT envelope_id, token_hash, team_id, user_id, device_id, code FROM checked".replace(
        "team_id, user_id, device_id, code", f"CASE WHEN code<>'unauthorized' THEN user_id END AS user_id, code"
    )
)
def ingest_with_stored_registry(spark, sf_dir):
    """Codes of all envelopes where tokens were revoked between two runs."""
    tables, _ = _revoked_between(spark, sf_dir)
    results = spark.read.parquet(tables.results)
    return results.select("envelope_id", "token_hash", "user_id", "code")


_LAST_SENT = """mine AS (SELECT * FROM base WHERE tool<>'other' AND (input_tokens>0 OR cached_input_tokens>0 OR output_tokens>0 OR reasoning_output_tokens>0)),
last_ AS (SELECT user_id, device_id, event_ts, event_key,
  row_number() OVER (PARTITION BY user_id, device_id ORDER BY event_ts DESC, event_key DESC) AS n FROM mine)"""


@query(
    o.with_(o.BASE, _LAST_SENT)
    + """SELECT l.user_id, l.device_id, l.event_key AS cursor_key, e.stored, e.copies FROM last_ l
JOIN (SELECT user_id, device_id, count(*) AS stored, count(*) AS copies FROM mine GROUP BY 1,2) e USING (user_id, device_id)
WHERE l.n=1"""
)
def collector_runs(spark, sf_dir):
    """A collector whose devices fail, are partly rejected, lose a reply and have nothing new: all arrives once.

    The receiver is the team ingest. Per device: where its cursor ends, events stored, and distinct keys of them.
    """
    d.configure(spark)
    # Decoded logs hold no event without usage; the receiver would refuse one for ever.
    base = d.usage(spark, sf_dir).filter(has_positive_usage())
    home, far = jobs.Tables(scratch_dir(spark, "collector")), jobs.Tables(scratch_dir(spark, "store"))
    devices = base.select(*DEVICE).distinct()
    names = devices.withColumns(
        {
            "token_hash": F.sha2("device_id", 256), "display_name": F.col("device_id"), "status": F.lit("active"),
            "created_at": F.lit("2024-01-01").cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp"), "token_preview": F.lit(""),
        }
    )
    registry_store.change_registry(spark, far, "register", upserts=names)
    number = F.pmod(F.xxhash64("device_id"), F.lit(5))

    def receive(tag: str, reached=F.lit(True), rejects=F.lit(False)):
        """Ingest what reaches the receiver; the others get no reply, some replies tell of a rejected event."""

        def send(outbox):
            name = F.concat_ws("/", F.lit(tag), "device_id", F.col("batch_no").cast("string"))
            sent = outbox.filter(reached).select(
                name.alias("envelope_id"), F.col("device_id").alias("token"), F.lit("2024-02-01").cast("timestamp").alias("uploaded_at"), "body",
            )
            results = jobs.run_team_ingest(spark, sent, None, far, d.ZONE, tag)
            told = results.select("envelope_id", (F.col("code") == "ok").alias("ok"), "accepted", "duplicate", F.col("rejected").alias("_rejected"))
            return (
                outbox.withColumn("envelope_id", name)
                .join(told, "envelope_id")
                .withColumn("rejected", F.col("_rejected") + F.when(rejects, 1).otherwise(0))
            )

        return send

    def lost(outbox):
        receive("two")(outbox)
        raise ConnectionError("the reply was lost")

    run = lambda n, cutoff, send: collector.run_collector(
        spark, base, devices, home, send, cutoff, d.AS_OF, n, batch=200
    )
    run(1, "2024-01-12 00:00:00", receive("one", reached=number != 1, rejects=number == 2))
    try:
        run(2, "2024-01-22 00:00:00", lost)
    except ConnectionError:
        pass
    run(3, "2024-01-25 00:00:00", receive("three"))
    run(4, "2024-03-01 00:00:00", receive("four"))
    run(5, "2024-03-01 00:00:00", receive("five"))
    run(5, "2024-03-01 00:00:00", lost)
    stored = jobs.read_runs(spark, far.events, jobs.TEAM_SCHEMA).groupBy("user_id", "device_id").agg(
        F.count("*").alias("stored"), F.count_distinct("event_key").alias("copies")
    )
    cursors = collector.current_cursors(spark, home)
    return cursors.join(stored, ["user_id", "device_id"]).select("user_id", "device_id", "cursor_key", "stored", "copies")


@query(
    o.with_(o.BASE, o.REGISTRY)
    + """SELECT token_hash, team_id, user_id, device_id,
  CASE WHEN token LIKE '%second' THEN 'Renamed' ELSE display_name END AS display_name,
  CASE WHEN token LIKE '%second' THEN 'active' ELSE status END AS status, created_at FROM registry"""
)
def upsert_registry(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    current = d.registry(base)
    second = F.sha2(F.concat("device_id", F.lit("-second")), 256)
    changes = current.filter(F.col("token_hash") == second).withColumns(
        {
            "display_name": F.lit("Renamed"),
            "status": F.lit("active"),
            "created_at": F.lit("2024-02-01").cast("timestamp"),
        }
    )
    return registry.upsert_registry(current, changes).select(
        "token_hash", *DEVICE, "display_name", "status", "created_at"
    )


@query(
    o.with_(o.BASE, o.REGISTRY)
    + "SELECT token_hash, team_id, user_id, device_id, status FROM registry WHERE status='active'"
)
def remove_registry(spark, sf_dir):
    current = _registry(spark, sf_dir)
    left = registry.remove_registry(current, current.filter(F.col("status") != "active"))
    return left.select("token_hash", *DEVICE, "status")


@query(
    o.with_(o.BASE, o.REGISTRY)
    + """SELECT team_id, user_id, device_id, display_name, status, created_at, last_seen_at, token_preview
FROM registry ORDER BY team_id, user_id, device_id, created_at, token_hash"""
)
def registry_listing(spark, sf_dir):
    return registry.registry_listing(_registry(spark, sf_dir))


_TOKEN = "CASE WHEN doc_id%7=0 THEN ' ' WHEN doc_id%3=0 THEN source ELSE source||'-token-'||doc_id END"


@query(
    f"""SELECT doc_id, CASE WHEN trim(token)='' THEN 'unrecoverable'
  WHEN length(token)<=12 THEN left(token,1)||'****'||right(token,1)
  ELSE left(token,6)||'****'||right(token,4) END AS token_preview, sha256(token) AS token_hash
FROM (SELECT doc_id, {_TOKEN} AS token FROM documents)"""
)
def register_tokens(spark, sf_dir):
    """Blank, short and long tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return registry.register_tokens(docs.select("doc_id", F.expr(_TOKEN).alias("token")))


@query(
    o.with_(o.BASE)
    + f"""SELECT event_key, session_id, model, event_ts, {", ".join(TOKENS)} FROM base
WHERE {o.MONTH} ORDER BY event_ts, event_key"""
)
def export_events(spark, sf_dir):
    return facts.export_events(d.usage_base(spark, sf_dir), SPAN.start, SPAN.end, d.ZONE)


_EVERY_DEVICE = "every AS (SELECT DISTINCT user_id, device_id FROM base)"


@query(
    o.with_(o.BASE, _EVERY_DEVICE)
    + """SELECT user_id, device_id, coalesce(batch_no,0) AS batch_no, coalesce(n,0) AS event_count,
  coalesce(keys,'') AS event_keys FROM every LEFT JOIN (
  SELECT user_id, device_id, batch_no, count(*) AS n, string_agg(event_key, ',' ORDER BY event_ts, event_key) AS keys
  FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, device_id ORDER BY event_ts, event_key)-1)//20 AS batch_no
    FROM base WHERE tool='codex') GROUP BY 1,2,3) USING (user_id, device_id)"""
)
def upload_outbox(spark, sf_dir):
    """Envelopes of twenty events per device; devices without events send a heartbeat."""
    base = d.usage_base(spark, sf_dir)
    sent = outbox.upload_outbox(base.filter(F.col("tool") == "codex"), base, batch=20)
    opened = env.open_envelopes(sent)
    keys = F.transform("events", lambda e: F.get_json_object(e, "$.event_key"))
    return opened.select(
        "user_id", "device_id", "batch_no", F.col("event_count").cast("bigint").alias("event_count"),
        F.array_join(keys, ",").alias("event_keys"),
    )


_CURSORS = """cursors AS (SELECT user_id, device_id, max(event_ts) AS cursor_ts,
    first(event_key ORDER BY event_ts DESC, event_key DESC) AS cursor_key
  FROM base WHERE event_ts < TIMESTAMP '2024-01-15' AND uid%3<>0 GROUP BY 1,2)"""
_PENDING = """pending AS (SELECT b.* FROM base b LEFT JOIN cursors c USING (user_id, device_id)
  WHERE b.event_ts <= TIMESTAMP '2024-01-25' AND CASE WHEN c.cursor_ts IS NULL THEN b.local_date >= DATE '2023-12-14'
    ELSE b.event_ts > c.cursor_ts OR (b.event_ts = c.cursor_ts AND b.event_key > c.cursor_key) END)"""


def _pending(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    return outbox.pending_after_cursor(base, d.cursors(base), "2024-01-25 00:00:00", d.AS_OF)


@query(
    o.with_(o.BASE, _CURSORS, _PENDING) + "SELECT user_id, device_id, event_ts, event_key FROM pending"
)
def pending_after_cursor(spark, sf_dir):
    return _pending(spark, sf_dir).select("user_id", "device_id", "event_ts", "event_key")


@query(
    o.with_(o.BASE, _CURSORS, _PENDING)
    + """, outcome AS (SELECT DISTINCT user_id, device_id, uid%7<>0 AS ok, CASE WHEN uid%5=0 THEN 1 ELSE 0 END AS rejected FROM base),
reached AS (SELECT user_id, device_id, max(event_ts) AS ts, first(event_key ORDER BY event_ts DESC, event_key DESC) AS key
  FROM pending JOIN outcome USING (user_id, device_id) WHERE ok AND rejected=0 GROUP BY 1,2)
SELECT user_id, device_id, coalesce(ts,cursor_ts) AS cursor_ts, coalesce(key,cursor_key) AS cursor_key
FROM cursors FULL JOIN reached USING (user_id, device_id)"""
)
def advance_cursor(spark, sf_dir):
    """Every seventh user's upload failed and every fifth one's had a rejected event."""
    base = d.usage_base(spark, sf_dir)
    outcomes = base.select(
        "user_id",
        "device_id",
        (F.col("uid") % 7 != 0).alias("ok"),
        F.when(F.col("uid") % 5 == 0, 1).otherwise(0).alias("rejected"),
    ).distinct()
    return outbox.advance_cursor(d.cursors(base), _pending(spark, sf_dir), outcomes)


@query(
    o.with_(o.BASE)
    + """SELECT count(DISTINCT session_id) AS files_scanned, count(DISTINCT CASE WHEN k%2=0 THEN session_id END) AS files_changed,
  count(*) FILTER (k%2=0) AS events_inserted, count(*) FILTER (k%2=1) AS events_skipped,
  count(*) FILTER (tool='other') AS errors, CASE WHEN count(*) FILTER (tool='other')=0 THEN 'ok' ELSE 'error' END AS status
FROM base"""
)
def merge_ingest_results(spark, sf_dir):
    """Run metrics of one run per session, merged."""
    even = F.col("k") % 2 == 0
    runs = (
        d.usage_base(spark, sf_dir)
        .groupBy("session_id")
        .agg(
            F.lit(1).alias("files_scanned"),
            F.max(even.cast("int")).alias("files_changed"),
            F.count_if(even).alias("events_inserted"),
            F.count_if(~even).alias("events_skipped"),
            F.count_if(F.col("tool") == "other").alias("errors"),
        )
    )
    return idempotent.merge_ingest_results(runs)


def _printed(report: DataFrame, key: str) -> DataFrame:
    """Report rows taken apart again: numbers as values, ratios exactly as printed."""

    def number(*names: str):
        return F.coalesce(*[F.get_json_object("item", f"$.{n}").cast("bigint") for n in names])

    def text(name: str):
        found = F.regexp_extract("item", f'"{name}":(-?[0-9.]+)', 1)
        return F.when(found != "", found)

    return report.select(
        "section",
        F.expr(key).alias("key"),
        number("total_tokens", "current_total_tokens").alias("tokens"),
        number("session_count", "sessions").alias("sessions"),
        number("call_count").alias("calls"),
        text("cache_hit_rate").alias("cache_hit_rate"),
        text("avg_tokens_per_call").alias("avg_tokens_per_call"),
        F.coalesce(text("total_tokens_rate"), text("delta_total_tokens_rate")).alias("rate"),
    )


def _printed_sql(section: str, key: str, source: str, kind: str) -> str:
    """The same columns of one section, ``kind`` saying which of them it has."""
    six = lambda c: f"CAST(CAST(round({c}, 6) AS DECIMAL(38,6)) AS VARCHAR)"
    has = {
        "rollup": f"total_tokens, sessions, call_count, {six('cache_hit_rate')}, CAST(CAST(round(avg_tokens_per_call, 2) AS DECIMAL(38,2)) AS VARCHAR), NULL",
        "period": "total_tokens, sessions, call_count, NULL, NULL, NULL",
        "delta": f"total_tokens, sessions, call_count, NULL, NULL, {six('total_tokens_rate')}",
        "change": f"current_total_tokens, NULL, NULL, NULL, NULL, {six('delta_total_tokens_rate')}",
        "none": "NULL, NULL, NULL, NULL, NULL, NULL",
    }[kind]
    return f"SELECT '{section}' AS section, {key} AS key, {has} FROM {source}"


def _report_sql(ctes: tuple[str, ...], parts: list[str]) -> str:
    columns = "(section, key, tokens, sessions, calls, cache_hit_rate, avg_tokens_per_call, rate)"
    return o.with_(*ctes) + f"SELECT * FROM ({' UNION ALL '.join(parts)}) p{columns}"


_LOCAL_KEY = """coalesce(get_json_object(item, '$.date'), get_json_object(item, '$.session_id'), get_json_object(item, '$.model'),
  get_json_object(item, '$.tool'), get_json_object(item, '$.period'), get_json_object(item, '$.day_index'), '')"""


@query(
    _report_sql(
        (
            o.BASE, o.USAGE, _SPINE_DAYS, *[
                o.rollup(keys, o.LOCAL_SESSION, name=name)
                for name, keys in (("rs", ()), ("rd", ("local_date",)), ("rm", ("model",)), ("rt", ("tool",)), ("re", ("session_id",)))
            ],
        ),
        [
            _printed_sql("summary", "''", "rs", "rollup"),
            _printed_sql("daily", "CAST(local_date AS VARCHAR)", f"(SELECT s.local_date, {o.filled('rd')} FROM spine s LEFT JOIN rd USING (local_date))", "rollup"),
            _printed_sql("models", "model", "rm", "rollup"),
            _printed_sql("tools", "tool", "rt", "rollup"),
            "SELECT 'sessions', session_id, total_tokens, NULL, call_count, NULL, CAST(CAST(round(avg_tokens_per_call, 2) AS DECIMAL(38,2)) AS VARCHAR), NULL FROM re",
            _printed_sql("comparison_summary", "period", f"({o.compare_summary(o.LOCAL_SESSION)})", "period"),
            _printed_sql("comparison_delta", "''", f"({o.compare_delta(o.LOCAL_SESSION)})", "delta"),
            _printed_sql("comparison_daily", "CAST(day_index AS VARCHAR)", f"({o.compare_daily()})", "change"),
            _printed_sql("comparison_models", "model", f"({o.compare_by(('model',))})", "change"),
            _printed_sql("comparison_tools", "tool", f"({o.compare_by(('tool',))})", "change"),
        ],
    )
)
def report_rows(spark, sf_dir):
    """The whole local report as JSON rows, each read back."""
    report = documents.local_report(spark, d.usage(spark, sf_dir), SPAN, WEEK, d.ZONE)
    printed = _printed(report, _LOCAL_KEY)
    session = F.col("section") == "sessions"
    return printed.withColumns(
        {c: F.when(~session, F.col(c)) for c in ("sessions", "cache_hit_rate")}
    )


_TEAM_KEY = """CASE section
  WHEN 'summary' THEN '' WHEN 'comparison_delta' THEN ''
  WHEN 'teams' THEN get_json_object(item, '$.team_id')
  WHEN 'users' THEN concat_ws('/', get_json_object(item, '$.team_id'), get_json_object(item, '$.user_id'))
  WHEN 'comparison_users' THEN concat_ws('/', get_json_object(item, '$.team_id'), get_json_object(item, '$.user_id'))
  WHEN 'devices' THEN concat_ws('/', get_json_object(item, '$.team_id'), get_json_object(item, '$.device_id'))
  WHEN 'team_models' THEN concat_ws('/', get_json_object(item, '$.date'), get_json_object(item, '$.user_id'), get_json_object(item, '$.tool'), get_json_object(item, '$.model'))
  WHEN 'user_daily' THEN concat_ws('/', get_json_object(item, '$.date'), get_json_object(item, '$.user_id'))
  WHEN 'upload_health' THEN concat_ws('/', get_json_object(item, '$.device_id'), get_json_object(item, '$.health_status'))
  WHEN 'uploads' THEN concat_ws('/', get_json_object(item, '$.device_id'), get_json_object(item, '$.upload_date'))
  ELSE coalesce(get_json_object(item, '$.date'), get_json_object(item, '$.model'), get_json_object(item, '$.tool'),
    get_json_object(item, '$.period'), get_json_object(item, '$.day_index')) END"""
_HEALTH = """(SELECT device_id, CASE WHEN status<>'ok' THEN 'error' WHEN gap>7200 THEN 'stale' WHEN gap>1800 THEN 'warning' ELSE 'ok' END AS health_status
  FROM (SELECT *, greatest(0, floor(epoch(max(upload_time) OVER ()))::BIGINT + 60 - floor(epoch(upload_time))::BIGINT) AS gap,
    row_number() OVER (PARTITION BY team_id, user_id, device_id ORDER BY upload_time DESC) AS nth FROM uploads) WHERE nth=1)"""


@query(
    _report_sql(
        (
            o.BASE, o.USAGE, _SPINE_DAYS, o.UPLOADS, *[
                o.rollup(keys, o.TEAM_SESSION, name=name)
                for name, keys in (
                    ("rs", ()), ("ra", ("team_id",)), ("ru", ("team_id", "user_id")), ("rv", ("team_id", "device_id")),
                    ("rm", ("model",)), ("rt", ("tool",)), ("rd", ("local_date",)), ("ry", ("local_date", "team_id", "user_id")),
                    ("rx", ("local_date", "team_id", "user_id", "tool", "model")),
                )
            ],
        ),
        [
            _printed_sql("summary", "''", "rs", "rollup"),
            _printed_sql("teams", "team_id", f"(SELECT team_id, {o.filled('ra')} FROM ra FULL JOIN (SELECT DISTINCT team_id FROM uploads) USING (team_id))", "rollup"),
            _printed_sql("users", "team_id||'/'||user_id", "ru", "rollup"),
            _printed_sql("devices", "team_id||'/'||device_id", "rv", "rollup"),
            _printed_sql("models", "model", "rm", "rollup"),
            _printed_sql("tools", "tool", "rt", "rollup"),
            _printed_sql("team_models", "local_date||'/'||user_id||'/'||tool||'/'||model", "rx", "rollup"),
            _printed_sql("daily", "CAST(local_date AS VARCHAR)", f"(SELECT s.local_date, {o.filled('rd')} FROM spine s LEFT JOIN rd USING (local_date))", "rollup"),
            _printed_sql("user_daily", "local_date||'/'||user_id", "ry", "rollup"),
            _printed_sql("upload_health", "device_id||'/'||health_status", _HEALTH, "none"),
            _printed_sql("uploads", "device_id||'/'||upload_date", "(SELECT * FROM uploads ORDER BY upload_time DESC, team_id, user_id, device_id LIMIT 50)", "none"),
            _printed_sql("comparison_summary", "period", f"({o.compare_summary(o.TEAM_SESSION)})", "period"),
            _printed_sql("comparison_delta", "''", f"({o.compare_delta(o.TEAM_SESSION)})", "delta"),
            _printed_sql("comparison_daily", "CAST(day_index AS VARCHAR)", f"({o.compare_daily()})", "change"),
            _printed_sql("comparison_users", "team_id||'/'||user_id", f"({o.compare_by(('team_id', 'user_id'))})", "change"),
            _printed_sql("comparison_models", "model", f"({o.compare_by(('model',))})", "change"),
            _printed_sql("comparison_tools", "tool", f"({o.compare_by(('tool',))})", "change"),
        ],
    )
)
def team_report_rows(spark, sf_dir):
    """The whole team report as JSON rows, each read back."""
    uploads = jobs.stage(spark, _uploads(spark, sf_dir), "uploads")
    last = uploads.agg(F.max(F.unix_seconds("upload_time"))).first()[0]
    report = documents.team_report(
        spark, d.usage(spark, sf_dir), _registry(spark, sf_dir), uploads, SPAN, WEEK,
        datetime.fromtimestamp(last + 60, timezone.utc), d.ZONE,
    )
    return _printed(report, _TEAM_KEY)


@query(
    o.with_(o.BASE, o.USAGE, _SPINE_DAYS, *[o.rollup(k, o.TEAM_SESSION, name=n) for n, k in (("rs", ()), ("rt", ("tool",)), ("rd", ("local_date",)))])
    + f"""SELECT 'summary' AS section, 0::BIGINT AS place, '' AS key, total_tokens, round(cache_hit_rate,6) AS cache_hit_rate FROM rs
UNION ALL SELECT 'tools', row_number() OVER (ORDER BY total_tokens DESC, tool), tool, total_tokens, round(cache_hit_rate,6) FROM rt
UNION ALL SELECT 'daily', row_number() OVER (ORDER BY local_date), CAST(local_date AS VARCHAR), total_tokens, round(cache_hit_rate,6)
  FROM (SELECT s.local_date, {o.filled('rd')} FROM spine s LEFT JOIN rd USING (local_date))"""
)
def report_document(spark, sf_dir):
    """Team report head: range, summary, days and tools in one document, read back in its order."""
    events = _month(spark, sf_dir)
    lists = {
        "tools": (team_reports.team_tools(events), ("-total_tokens", "tool")),
        "daily": (team_reports.team_daily(spark, events, SPAN), ("local_date",)),
    }
    text = documents.report_document(team_reports.team_summary(events), SPAN, d.ZONE, lists)
    item = "struct<tool:string,date:string,total_tokens:bigint,cache_hit_rate:double>"
    read = text.select(
        F.from_json("document", f"summary {item}, tools array<{item}>, daily array<{item}>").alias("r")
    ).selectExpr(
        "explode(array(named_struct('section', 'summary', 'items', array(r.summary)),"
        " named_struct('section', 'tools', 'items', r.tools), named_struct('section', 'daily', 'items', r.daily))) AS s"
    ).selectExpr("s.section", "posexplode(s.items) AS (place, i)")
    return read.selectExpr(
        "section", "CAST(place + int(section <> 'summary') AS bigint) AS place", "coalesce(i.tool, i.date, '') AS key",
        "i.total_tokens", "i.cache_hit_rate",
    )


# --- filters and periods -----------------------------------------------------


@query(
    o.with_(o.BASE)
    + "SELECT event_key, local_date, total_tokens FROM base WHERE local_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-17'"
)
def in_range(spark, sf_dir):
    span = periods.resolve_range(d.AS_OF, days=7)
    return facts.in_range(d.usage_base(spark, sf_dir), span.start, span.end, d.ZONE).select(
        "event_key", "local_date", "total_tokens"
    )


@query(
    o.with_(o.BASE)
    + "SELECT event_key, team_id, user_id, tool FROM base WHERE team_id='team-1' AND tool='codex'"
)
def match_team_and_tool(spark, sf_dir):
    return facts.match(d.usage_base(spark, sf_dir), team_id="team-1", user_id=" ", tool="codex").select(
        "event_key", "team_id", "user_id", "tool"
    )


@query(
    o.with_(o.BASE)
    + """SELECT v.kind, v.start_date, v.end_date, count(b.event_key) AS events,
  coalesce(sum(b.total_tokens),0)::BIGINT AS total_tokens
FROM (VALUES ('days-1',DATE '2024-01-17',DATE '2024-01-17'),('days-7',DATE '2024-01-11',DATE '2024-01-17'),
  ('days-30',DATE '2023-12-19',DATE '2024-01-17'),('month-current',DATE '2024-01-01',DATE '2024-01-31'),
  ('month-2024-02',DATE '2024-02-01',DATE '2024-02-29')) v(kind,start_date,end_date)
LEFT JOIN base b ON b.local_date BETWEEN v.start_date AND v.end_date GROUP BY ALL"""
)
def resolve_range(spark, sf_dir):
    wanted = {
        "days-1": periods.resolve_range(d.AS_OF, days=1),
        "days-7": periods.resolve_range(d.AS_OF),
        "days-30": periods.resolve_range(d.AS_OF, days="30"),
        "month-current": periods.resolve_range(d.AS_OF, days=7, month="current"),
        "month-2024-02": periods.resolve_range(d.AS_OF, month="2024-02"),
    }
    days = (
        d.usage_base(spark, sf_dir)
        .groupBy("local_date")
        .agg(F.count("*").alias("n"), F.sum("total_tokens").alias("t"))
    )
    spans = spark.createDataFrame(
        [(k, s.start, s.end) for k, s in wanted.items()], "kind string, start_date date, end_date date"
    )
    # Dates of a range as rows, so that the join is an equality.
    dates = spans.withColumn(
        "local_date", F.explode(F.sequence("start_date", "end_date"))
    )
    return (
        dates.join(days, "local_date", "left")
        .groupBy("kind", "start_date", "end_date")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
            F.coalesce(F.sum("t"), F.lit(0)).alias("total_tokens"),
        )
    )


def _period_rows(pairs) -> str:
    rows = []
    for name, (current, previous) in pairs.items():
        rows.append(f"('{name}','current',DATE '{current[0]}',DATE '{current[1]}')")
        rows.append(f"('{name}','previous',DATE '{previous[0]}',DATE '{previous[1]}')")
    return ", ".join(rows)


@query(
    o.with_(o.BASE, o.DEC)
    + f"""SELECT v.kind, v.period, count(m.event_key) AS events, coalesce(sum(m.total_tokens),0)::BIGINT AS total_tokens
FROM (VALUES {_period_rows({
    "day": (("2024-01-17", "2024-01-17"), ("2024-01-16", "2024-01-16")),
    "week": (("2024-01-15", "2024-01-17"), ("2024-01-08", "2024-01-10")),
    "month": (("2024-01-01", "2024-01-17"), ("2023-12-01", "2023-12-17")),
})}) v(kind,period,a,b) LEFT JOIN moved m ON m.local_date BETWEEN v.a AND v.b GROUP BY ALL"""
)
def resolve_period(spark, sf_dir):
    moved = d.usage_dec(d.usage_base(spark, sf_dir)).select("event_ts", "total_tokens")
    out = None
    for kind in periods.PERIOD_LABELS:
        pair = periods.resolve_period(kind, d.AS_OF)
        part = (
            periods.split_periods(moved, pair, d.ZONE)
            .groupBy(F.lit(kind).alias("kind"), "period")
            .agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"))
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(o.with_(o.BASE, o.periods(o.WEEK)) + "SELECT event_key, local_date, period FROM p")
def split_periods(spark, sf_dir):
    return periods.split_periods(d.usage(spark, sf_dir), WEEK, d.ZONE).select(
        "event_key", "local_date", "period"
    )


@query(
    o.with_(o.BASE)
    + f"""SELECT event_key, model<>'unknown' AS known_model, tool<>'other' AS known_tool,
  {o.POSITIVE} AS positive_usage FROM base"""
)
def event_predicates(spark, sf_dir):
    return d.usage_base(spark, sf_dir).select(
        "event_key",
        is_known_model(F.col("model")).alias("known_model"),
        is_known_tool(F.col("tool")).alias("known_tool"),
        has_positive_usage().alias("positive_usage"),
    )


# --- joins and metrics -------------------------------------------------------


@query(
    o.with_(o.BASE, o.REGISTRY)
    + """SELECT b.event_key, CASE WHEN coalesce(trim(n.device_name),'')='' THEN b.user_id ELSE n.device_name END AS user_display_name,
  CASE WHEN coalesce(trim(n.device_name),'')='' THEN b.device_id ELSE n.device_name END AS device_display_name
FROM base b LEFT JOIN names n USING (team_id, user_id, device_id)"""
)
def enrich_device(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    return registry.enrich_device(
        base.select("event_key", *DEVICE), d.registry(base)
    ).select("event_key", "user_display_name", "device_display_name")


_TEAM_METRICS = (*o.LONGS, *o.DOUBLES, "started_at", "ended_at", "users", "devices")
_LOCAL_METRICS = (*o.LONGS, *o.DOUBLES, "started_at", "ended_at")


def _columns(*groups) -> str:
    return ", ".join(c for g in groups for c in g)


@query(
    o.with_(o.BASE, o.CALLS, "u AS (SELECT * FROM calls WHERE tool<>'other')", o.rollup(("team_id", "tool", "model"), o.TEAM_SESSION))
    + f"SELECT {_columns(('team_id', 'tool', 'model'), _TEAM_METRICS)} FROM r"
)
def usage_rollup(spark, sf_dir):
    """Every metric at a mixed grain, with repeated calls."""
    events = d.usage_calls(d.usage(spark, sf_dir))
    return rollup.usage_rollup(events, ["team_id", "tool", "model"], TEAM)


@query(
    o.with_(o.BASE, o.CALLS, "u AS (SELECT * FROM calls WHERE tool<>'other')", o.rollup(("user_id",), o.TEAM_SESSION))
    + "SELECT user_id, usage_event_count, call_count, active_seconds, avg_tokens_per_call FROM r"
)
def call_count(spark, sf_dir):
    events = d.usage_calls(d.usage(spark, sf_dir))
    return rollup.usage_rollup(events, ["user_id"], TEAM).select(
        "user_id", "usage_event_count", "call_count", "active_seconds", "avg_tokens_per_call"
    )


@query(
    o.with_(o.BASE, "u AS (SELECT * FROM base)", o.rollup(o.TEAM_SESSION, o.TEAM_SESSION))
    + f"SELECT {_columns(o.TEAM_SESSION)}, active_seconds, started_at, ended_at FROM r"
)
def active_seconds(spark, sf_dir):
    return rollup.usage_rollup(d.usage_base(spark, sf_dir), list(TEAM.session), TEAM).select(
        *TEAM.session, "active_seconds", "started_at", "ended_at"
    )


@query(
    o.with_(o.BASE)
    + """SELECT 'source_kind' AS dimension, tool, CASE WHEN source_kind='' THEN 'unknown' ELSE source_kind END AS value,
  count(*) AS count FROM base GROUP BY ALL UNION ALL
SELECT 'source_quality', tool, CASE WHEN source_quality='' THEN 'unknown' ELSE source_quality END, count(*) FROM base GROUP BY ALL"""
)
def source_histograms(spark, sf_dir):
    base = d.usage_base(spark, sf_dir)
    parts = [
        rollup.value_counts(base, ["tool"], c).select(F.lit(c).alias("dimension"), "tool", "value", "count")
        for c in ("source_kind", "source_quality")
    ]
    return parts[0].unionByName(parts[1])


@query(
    o.with_(o.BASE)
    + f"""SELECT local_date, delta, previous, {o.rate("delta", "previous")} AS change_rate,
  {o.share("total_tokens", "previous")} AS share FROM (
  SELECT local_date, total_tokens, coalesce(lag(total_tokens) OVER w,0) AS previous,
    total_tokens-coalesce(lag(total_tokens) OVER w,0) AS delta
  FROM (SELECT local_date, sum(total_tokens)::BIGINT AS total_tokens FROM base GROUP BY 1) WINDOW w AS (ORDER BY local_date))"""
)
def change_rate(spark, sf_dir):
    days = d.usage_base(spark, sf_dir).groupBy("local_date").agg(F.sum("total_tokens").alias("t"))
    previous = F.coalesce(F.lag("t").over(Window.orderBy("local_date")), F.lit(0))
    return days.withColumn("previous", previous).withColumn("delta", F.col("t") - F.col("previous")).select(
        "local_date",
        "delta",
        "previous",
        measures.change_rate(F.col("delta"), F.col("previous")).alias("change_rate"),
        measures.share(F.col("t"), F.col("previous")).alias("share"),
    )


# --- local reports -----------------------------------------------------------

_L = o.LOCAL_SESSION
_KIND = f"kinds AS ({o.histogram_text('source_kind')})"
_QUALITY = f"qualities AS ({o.histogram_text('source_quality')})"


@query(
    o.with_(o.BASE, o.USAGE, o.rollup((), _L), _KIND, _QUALITY)
    + f"SELECT {_columns(_LOCAL_METRICS)}, source_kind, source_quality FROM r, kinds, qualities"
)
def local_summary(spark, sf_dir):
    return local_reports.local_summary(_month(spark, sf_dir))


_SPINE = _SPINE_DAYS


@query(
    o.with_(o.BASE, o.USAGE, o.rollup(("local_date",), _L), _SPINE)
    + f"SELECT s.local_date, {o.filled('r')}, r.started_at, r.ended_at FROM spine s LEFT JOIN r USING (local_date)"
)
def local_daily(spark, sf_dir):
    return local_reports.local_daily(spark, _month(spark, sf_dir), SPAN)


@query(
    o.with_(o.BASE, o.USAGE, o.rollup(("model",), _L), f"t AS ({o.values_text('tool', 'tools', ('model',))})")
    + f"SELECT model, {_columns(_LOCAL_METRICS)}, tools FROM r JOIN t USING (model)"
)
def local_models(spark, sf_dir):
    return local_reports.local_models(_month(spark, sf_dir))


@query(
    o.with_(
        o.BASE, o.USAGE, o.rollup(("tool",), _L),
        f"kinds AS ({o.histogram_text('source_kind', ('tool',))})",
        f"qualities AS ({o.histogram_text('source_quality', ('tool',))})",
    )
    + f"SELECT tool, {_columns(_LOCAL_METRICS)}, source_kind, source_quality FROM r JOIN kinds USING (tool) JOIN qualities USING (tool)"
)
def local_tools(spark, sf_dir):
    return local_reports.local_tools(_month(spark, sf_dir))


_SESSION_CHAIN = (
    o.BASE, o.USAGE, o.rollup(("session_id",), _L),
    f"t AS ({o.values_text('tool', 'tools', ('session_id',))})",
    f"m AS ({o.values_text('model', 'models', ('session_id',))})",
)
_SESSION_SELECT = f"SELECT session_id, {_columns(_LOCAL_METRICS)}, tools, models FROM r JOIN t USING (session_id) JOIN m USING (session_id)"


@query(o.with_(*_SESSION_CHAIN) + _SESSION_SELECT)
def local_sessions(spark, sf_dir):
    return local_reports.local_sessions(_month(spark, sf_dir))


@query(
    o.with_(*_SESSION_CHAIN)
    + _SESSION_SELECT
    + " ORDER BY started_at DESC, session_id LIMIT 10 OFFSET 20"
)
def local_sessions_page(spark, sf_dir):
    return local_reports.local_sessions_page(_month(spark, sf_dir), page=3, page_size=10)[0]


@query(
    o.with_(*_SESSION_CHAIN)
    + _SESSION_SELECT
    + " ORDER BY started_at DESC, session_id LIMIT 10 OFFSET 150"
)
def local_sessions_deep_page(spark, sf_dir):
    """A page far down the list."""
    return local_reports.local_sessions_page(_month(spark, sf_dir), page=16, page_size=10)[0]


def _local_store(spark, sf_dir) -> jobs.Tables:
    """A local store of three commits, each batch replaying those before; keys and summary merged in between."""
    tables = jobs.Tables(scratch_dir(spark, "store"))
    every = d.usage(spark, sf_dir).withColumns({"source_path": F.lit("log"), "line_number": F.col("event_id")})
    for run_id in range(3):
        batch = every.filter(F.col("event_id") % 3 <= run_id).select(*jobs.LOCAL_SCHEMA.names)
        new = idempotent.insert_new_events(
            batch, jobs.stored_events(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS), ("event_key",),
            ("source_path", "line_number"), keep=lambda first: jobs.stage(spark, first, "first"),
        )
        attempt = jobs.Attempt.begin(spark, tables, run_id)
        jobs.store_local_events(spark, tables, attempt, new)
        attempt.commit()
        if run_id == 1:
            jobs.build_key_table(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
            jobs.merge_session_summary(spark, tables)
    return tables


@query(o.with_(o.BASE, o.USAGE) + "SELECT event_key, tool, session_id, event_ts, local_date, total_tokens FROM u")
def insert_by_key_table(spark, sf_dir):
    """A store fed by overlapping batches, whose keys are looked up in the key table: each event once."""
    d.configure(spark)
    tables = _local_store(spark, sf_dir)
    stored = jobs.read_runs(spark, tables.events, jobs.LOCAL_SCHEMA)
    return stored.select("event_key", "tool", "session_id", "event_ts", "local_date", "total_tokens")


@query(o.with_(o.BASE, o.USAGE) + "SELECT event_key, tool, session_id, event_ts, local_date, total_tokens, 1::BIGINT AS attempts_a_month FROM u")
def store_generations(spark, sf_dir):
    """The same store merged into one generation, old folders removed: equal events, one attempt per month."""
    d.configure(spark)
    tables = _local_store(spark, sf_dir)
    jobs.compact(spark, tables, jobs.LOCAL_SCHEMA, jobs.LOCAL_KEYS)
    generations.retire(spark, tables)
    stored = jobs.read_runs(spark, tables.events, jobs.LOCAL_SCHEMA)
    placed = stored.withColumn("_attempt", F.regexp_extract(F.input_file_name(), "attempt=([0-9a-f]+)/", 1))
    months = placed.groupBy(F.col("year_month").alias("_month")).agg(F.count_distinct("_attempt").alias("attempts_a_month"))
    return stored.join(months, F.col("year_month").eqNullSafe(F.col("_month"))).select(
        "event_key", "tool", "session_id", "event_ts", "local_date", "total_tokens", "attempts_a_month"
    )


@query(o.with_(*_SESSION_CHAIN) + _SESSION_SELECT)
def local_sessions_from_summary(spark, sf_dir):
    """All sessions of the month from the stored summary, whose parts came in overlapping batches."""
    d.configure(spark)
    _, calls = jobs.session_summary(spark, _local_store(spark, sf_dir))
    return sessions.summary_sessions(calls, SPAN)


@query(
    o.with_(*_SESSION_CHAIN)
    + _SESSION_SELECT
    + " ORDER BY started_at DESC, session_id LIMIT 10 OFFSET 20"
)
def local_sessions_page_from_summary(spark, sf_dir):
    """The same page as from events, without reading one."""
    d.configure(spark)
    days, calls = jobs.session_summary(spark, _local_store(spark, sf_dir))
    return sessions.summary_page(days, calls, SPAN, page=3, page_size=10)[0]


@query(
    o.with_(o.BASE, o.USAGE)
    + """SELECT 3::BIGINT AS page, 10::BIGINT AS page_size, count(DISTINCT session_id) AS total,
  greatest(1, CAST(ceil(count(DISTINCT session_id)/10.0) AS BIGINT)) AS total_pages FROM u"""
)
def local_sessions_page_info(spark, sf_dir):
    return local_reports.local_sessions_page(_month(spark, sf_dir), page=3, page_size=10)[1]


@query(o.compare_summary(_L))
def local_compare_summary(spark, sf_dir):
    return local_reports.local_compare_summary(spark, d.usage(spark, sf_dir), WEEK, d.ZONE)


@query(o.compare_delta(_L))
def local_compare_delta(spark, sf_dir):
    return local_reports.local_compare_delta(d.usage(spark, sf_dir), WEEK, d.ZONE)


@query(o.compare_daily())
def local_compare_daily(spark, sf_dir):
    return local_reports.local_compare_daily(spark, d.usage(spark, sf_dir), WEEK, d.ZONE)


_UTC_DAYS = "moved AS (SELECT * REPLACE (CAST(event_ts AS DATE) AS local_date) FROM base)"


@query(o.compare_daily(_UTC_DAYS))
def local_compare_daily_utc(spark, sf_dir):
    """Days of another zone than the one the facts were written in."""
    return local_reports.local_compare_daily(spark, d.usage(spark, sf_dir), WEEK, "UTC")


@query(o.compare_by(("model",)))
def local_compare_models(spark, sf_dir):
    return local_reports.local_compare_models(d.usage(spark, sf_dir), WEEK, d.ZONE)


@query(o.compare_by(("tool",)))
def local_compare_tools(spark, sf_dir):
    return local_reports.local_compare_tools(d.usage(spark, sf_dir), WEEK, d.ZONE)


# --- team reports ------------------------------------------------------------

_T = o.TEAM_SESSION
_NAMED = "CASE WHEN coalesce(trim(n.device_name),'')='' THEN r.user_id ELSE n.device_name END AS display_name"


def _user_named(keys) -> tuple[str, ...]:
    return (o.BASE, o.USAGE, o.rollup(keys, _T), o.first_device(keys), o.REGISTRY)


def _user_select(keys, more="") -> str:
    return f"""SELECT {", ".join("r." + k for k in keys)}, {_columns(_TEAM_METRICS)}, {_NAMED}{more}
FROM r JOIN fd USING ({_columns(keys)}) LEFT JOIN names n
  ON n.team_id=r.team_id AND n.user_id=r.user_id AND n.device_id=fd.first_device"""


@query(
    o.with_(
        o.BASE, o.USAGE, o.rollup((), _T), _KIND, _QUALITY,
        "latest AS (SELECT team_id FROM u ORDER BY event_ts DESC, team_id DESC LIMIT 1)",
    )
    + f"SELECT {_columns(_TEAM_METRICS)}, team_id, source_kind, source_quality FROM r, kinds, qualities, latest"
)
def team_summary(spark, sf_dir):
    return team_reports.team_summary(_month(spark, sf_dir))


@query(
    o.with_(
        o.BASE, "u AS (SELECT * FROM base WHERE tool<>'other')", o.rollup(("team_id",), _T), o.UPLOADS,
        """latest AS (SELECT team_id, max(upload_time) AS last_upload_at FROM (SELECT team_id, upload_time FROM uploads
    UNION ALL SELECT team_id||'-silent', upload_time FROM uploads WHERE team_id='team-2') GROUP BY 1)""",
    )
    + f"""SELECT team_id, {o.filled('r', ('users', 'devices'))}, r.started_at, r.ended_at, last_upload_at
FROM r FULL JOIN latest USING (team_id)"""
)
def team_rollup(spark, sf_dir):
    """All teams, and one that has uploads but no events."""
    uploads = _uploads(spark, sf_dir)
    silent = uploads.filter(F.col("team_id") == "team-2").withColumn("team_id", F.lit("team-2-silent"))
    return team_reports.team_rollup(d.usage(spark, sf_dir), uploads.unionByName(silent))


_USER = ("team_id", "user_id")


@query(o.with_(*_user_named(_USER)) + _user_select(_USER, ", ended_at AS last_seen_at"))
def team_users(spark, sf_dir):
    return team_reports.team_users(_month(spark, sf_dir), _registry(spark, sf_dir))


@query(
    o.with_(
        o.BASE, o.USAGE, o.rollup(("team_id", "device_id"), _T), o.REGISTRY,
        """owners AS (SELECT team_id, device_id, first(user_id ORDER BY started, user_id) AS user_id FROM (
    SELECT team_id, user_id, device_id, session_id, min(event_ts) AS started FROM u GROUP BY ALL) GROUP BY 1,2)""",
    )
    + f"""SELECT r.team_id, r.device_id, {_columns(_TEAM_METRICS)}, w.user_id, ended_at AS last_seen_at,
  CASE WHEN coalesce(trim(n.device_name),'')='' THEN r.device_id ELSE n.device_name END AS display_name
FROM r JOIN owners w USING (team_id, device_id) LEFT JOIN names n
  ON n.team_id=r.team_id AND n.user_id=w.user_id AND n.device_id=r.device_id"""
)
def team_devices(spark, sf_dir):
    return team_reports.team_devices(_month(spark, sf_dir), _registry(spark, sf_dir))


@query(o.with_(o.BASE, o.USAGE, o.rollup(("model",), _T)) + f"SELECT model, {_columns(_TEAM_METRICS)} FROM r")
def team_models(spark, sf_dir):
    return team_reports.team_models(_month(spark, sf_dir))


@query(
    o.with_(
        o.BASE, f"u AS (SELECT * FROM base WHERE tool='codex' AND team_id='team-1' AND {o.MONTH})", o.rollup(("model",), _T)
    )
    + f"SELECT model, {_columns(_TEAM_METRICS)} FROM r"
)
def team_models_filtered(spark, sf_dir):
    """A report of one team and one tool."""
    chosen = facts.match(_month(spark, sf_dir), team_id="team-1", tool="codex", user_id=" ")
    return team_reports.team_models(chosen)


@query(
    o.with_(
        o.BASE, o.USAGE, o.rollup(("tool",), _T),
        f"kinds AS ({o.histogram_text('source_kind', ('tool',))})",
        f"qualities AS ({o.histogram_text('source_quality', ('tool',))})",
    )
    + f"SELECT tool, {_columns(_TEAM_METRICS)}, source_kind, source_quality FROM r JOIN kinds USING (tool) JOIN qualities USING (tool)"
)
def team_tools(spark, sf_dir):
    return team_reports.team_tools(_month(spark, sf_dir))


_DETAIL = ("local_date", "team_id", "user_id", "tool", "model")


@query(o.with_(*_user_named(_DETAIL)) + _user_select(_DETAIL))
def team_model_detail(spark, sf_dir):
    return team_reports.team_model_detail(_month(spark, sf_dir), _registry(spark, sf_dir))


@query(
    o.with_(o.BASE, o.USAGE, o.rollup(("local_date",), _T), _SPINE)
    + f"SELECT s.local_date, {o.filled('r', ('users', 'devices'))}, r.started_at, r.ended_at FROM spine s LEFT JOIN r USING (local_date)"
)
def team_daily(spark, sf_dir):
    return team_reports.team_daily(spark, _month(spark, sf_dir), SPAN)


_USER_DAY = ("local_date", "team_id", "user_id")


@query(o.with_(*_user_named(_USER_DAY)) + _user_select(_USER_DAY))
def team_user_daily(spark, sf_dir):
    return team_reports.team_user_daily(_month(spark, sf_dir), _registry(spark, sf_dir))


@query(
    o.with_(
        o.BASE,
        """arrived AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 3 WHEN local_date <= DATE '2024-01-15' THEN 1 ELSE 2 END AS batch,
    (local_date + 1)::TIMESTAMP - INTERVAL 8 HOURS AS day_end FROM base)""",
        """marks AS (SELECT max(event_ts) FILTER (batch <= 2) - INTERVAL 2 HOURS AS before_third,
    max(event_ts) - INTERVAL 2 HOURS AS last FROM arrived)""",
    )
    + f"""SELECT CASE WHEN batch = 3 AND day_end <= before_third THEN 'late' WHEN day_end <= last THEN 'closed' ELSE 'open' END AS state,
  local_date, team_id, tool, {", ".join(f"sum({t})::BIGINT AS {t}" for t in TOKENS)}, count(*) AS usage_event_count
  FROM arrived, marks GROUP BY 1,2,3,4"""
)
def stream_closing_days(spark, sf_dir):
    """Two halves of the month, then every tenth event of both: closed and open days, and the late rows by day."""
    d.configure(spark)
    columns = ("event_id", "event_ts", "team_id", "tool", *TOKENS)
    source = d.usage_base(spark, sf_dir).select(*columns)
    drop, checkpoint = scratch_dir(spark, "stream-source"), scratch_dir(spark, "stream-checkpoint")
    days = ClosingDays(scratch_dir(spark, "closing-days"), d.ZONE, "2 hours")
    tenth, early = F.col("event_id") % 10 == 0, local_date(F.col("event_ts"), d.ZONE) <= F.lit("2024-01-15").cast("date")
    for number, part in enumerate((~tenth & early, ~tenth & ~early, tenth)):
        source.where(part).write.parquet(f"{drop}/{number}")
        stream = spark.readStream.schema(source.schema).parquet(f"{drop}/*")
        days.start(stream, checkpoint).awaitTermination()
    late = days.late_rows(spark, source.schema).groupBy("local_date", "team_id", "tool").agg(
        *[F.sum(t).alias(t) for t in TOKENS], F.count(F.lit(1)).alias("usage_event_count")
    )
    parts = (("closed", days.closed_days(spark)), ("open", days.open_days(spark)), ("late", late))
    rows = [df.withColumn("state", F.lit(state)) for state, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    o.with_(
        o.BASE, o.USAGE,
        """counted AS (SELECT 'source_kind' AS dimension, tool, CASE WHEN source_kind='' THEN 'unknown' ELSE source_kind END AS value,
    count(*) AS n FROM u GROUP BY ALL UNION ALL
  SELECT 'source_quality', tool, CASE WHEN source_quality='' THEN 'unknown' ELSE source_quality END, count(*) FROM u GROUP BY ALL)""",
    )
    + "SELECT *, row_number() OVER (PARTITION BY dimension, tool ORDER BY n DESC, value) <= 1 AS in_map FROM counted"
)
def bounded_histograms(spark, sf_dir):
    """Maps of the heaviest value per tool, here one, and all other values as rows."""
    grains = Grains(_month(spark, sf_dir), LOCAL, (local_reports.TOOLS,))
    maps = grains.value_maps("tools", local_reports.HISTOGRAMS, most=1)
    rows = [
        maps.select(F.lit(c).alias("dimension"), "tool", F.explode(c).alias("value", "n"), F.lit(True).alias("in_map"))
        for c in local_reports.HISTOGRAMS
    ]
    beyond = local_reports.beyond_maps(grains, "tools", most=1).withColumn("in_map", F.lit(False))
    return rows[0].unionByName(rows[1]).unionByName(beyond)


@query(
    o.with_(o.BASE, o.UPLOADS)
    + """SELECT team_id, user_id, device_id, upload_time AS last_upload_at, gap AS upload_gap_seconds,
  CASE WHEN status<>'ok' THEN 'error' WHEN gap>7200 THEN 'stale' WHEN gap>1800 THEN 'warning' ELSE 'ok' END AS health_status,
  status AS latest_status, accepted AS latest_accepted, duplicate AS latest_duplicate, rejected AS latest_rejected
FROM (SELECT *, greatest(0, floor(epoch(max(upload_time) OVER ()))::BIGINT + 60 - floor(epoch(upload_time))::BIGINT) AS gap,
  row_number() OVER (PARTITION BY team_id, user_id, device_id ORDER BY upload_time DESC) AS nth FROM uploads)
WHERE nth=1"""
)
def upload_health(spark, sf_dir):
    """The whole ledger, seen a minute after its last upload."""
    uploads = _uploads(spark, sf_dir)
    last = uploads.agg(F.max(F.unix_seconds("upload_time"))).first()[0]
    return team_reports.upload_health(uploads, datetime.fromtimestamp(last + 60, timezone.utc))


@query(
    o.with_(o.BASE, o.UPLOADS)
    + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id, user_id, device_id ORDER BY upload_time DESC) AS position
  FROM uploads) WHERE position<=3"""
)
def recent_uploads(spark, sf_dir):
    return team_reports.recent_uploads(_uploads(spark, sf_dir))


@query(
    o.with_(o.BASE, o.UPLOADS)
    + "SELECT * FROM uploads ORDER BY upload_time DESC, team_id, user_id, device_id LIMIT 50"
)
def upload_list(spark, sf_dir):
    return team_reports.upload_list(_uploads(spark, sf_dir))


@query(o.compare_summary(_T, o.DEC, o.MONTH_PAIR, ("This Month", "Previous Month")))
def team_compare_summary(spark, sf_dir):
    """Month to date against the same days of December."""
    return team_reports.team_compare_summary(spark, d.usage_dec(d.usage(spark, sf_dir)), MONTH, d.ZONE)


@query(o.compare_delta(_T))
def team_compare_delta(spark, sf_dir):
    return team_reports.team_compare_delta(d.usage(spark, sf_dir), WEEK, d.ZONE)


@query(o.compare_daily(o.DEC, o.MONTH_PAIR, 17))
def team_compare_daily(spark, sf_dir):
    return team_reports.team_compare_daily(spark, d.usage_dec(d.usage(spark, sf_dir)), MONTH, d.ZONE)


@query(
    o.compare_by(
        _USER,
        ", CASE WHEN coalesce(trim(n.device_name),'')='' THEN d.user_id ELSE n.device_name END AS display_name",
        (
            """fd AS (SELECT team_id, user_id,
    first(device_id ORDER BY CASE period WHEN 'current' THEN 0 ELSE 1 END, event_ts, device_id) AS first_device
  FROM p GROUP BY 1,2)""",
            o.REGISTRY,
        ),
        "JOIN fd USING (team_id, user_id) LEFT JOIN names n ON n.team_id=d.team_id AND n.user_id=d.user_id AND n.device_id=fd.first_device",
    )
)
def team_compare_users(spark, sf_dir):
    return team_reports.team_compare_users(d.usage(spark, sf_dir), _registry(spark, sf_dir), WEEK, d.ZONE)


@query(o.compare_by(("model",)))
def team_compare_models(spark, sf_dir):
    return team_reports.team_compare_models(d.usage(spark, sf_dir), WEEK, d.ZONE)


@query(o.compare_by(("tool",)))
def team_compare_tools(spark, sf_dir):
    return team_reports.team_compare_tools(d.usage(spark, sf_dir), WEEK, d.ZONE)


# --- dashboard ---------------------------------------------------------------


@query(
    o.with_(*_user_named(_DETAIL))
    + _user_select(_DETAIL)
    + " ORDER BY r.total_tokens DESC, r.local_date DESC, r.tool, r.model, r.team_id, r.user_id LIMIT 50"
)
def ranked_team_models(spark, sf_dir):
    return team_reports.ranked_team_models(_month(spark, sf_dir), _registry(spark, sf_dir))


@query(
    o.with_(*_user_named(_DETAIL))
    + _user_select(_DETAIL)
    + " ORDER BY lower(display_name), r.local_date DESC, r.tool, r.model, r.team_id, r.user_id LIMIT 50"
)
def ranked_team_models_by_name(spark, sf_dir):
    return team_reports.ranked_team_models(
        _month(spark, sf_dir), _registry(spark, sf_dir), field="display_name", descending=False
    )


@query(
    o.with_(o.BASE, o.USAGE, o.rollup(("model",), _T))
    + f"SELECT model, {_columns(_TEAM_METRICS)} FROM r ORDER BY total_tokens DESC, model LIMIT 6"
)
def overview_top6(spark, sf_dir):
    return team_reports.overview_top6(team_reports.team_models(_month(spark, sf_dir)))


@query(
    o.with_(o.BASE)
    + "SELECT DISTINCT 'team' AS facet, team_id AS value FROM base UNION SELECT DISTINCT 'tool', tool FROM base"
)
def filter_facets(spark, sf_dir):
    return team_reports.filter_facets(d.usage_base(spark, sf_dir))


@query(o.with_(o.BASE, o.USAGE) + "SELECT count(*)>0 OR coalesce(sum(total_tokens),0)>0 AS has_usage FROM u")
def has_usage(spark, sf_dir):
    return team_reports.has_usage(_month(spark, sf_dir))


@query(
    o.with_(o.BASE)
    + "SELECT event_ts, event_key, row_number() OVER (ORDER BY event_ts, event_key) AS place FROM base"
)
def ordered_events(spark, sf_dir):
    """Events in order; places by counting, so that the order itself is checked."""
    events = d.usage_base(spark, sf_dir).select("event_ts", "event_key")
    order = (F.col("event_ts").asc(), F.col("event_key").asc())
    placed = rank.ranked(events, order, name="place")
    return facts.ordered_events(placed)


# --- streams -----------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    """The derived usage events as a stream over the table's own file."""
    d.configure(spark)
    path = scratch_dir(spark, "stream-source")
    source = d.team_events(d.usage_base(spark, sf_dir)).select(*columns)
    source.write.parquet(path)
    return spark.readStream.schema(source.schema).parquet(path)


def _finished(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    out, checkpoint = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-checkpoint")
    running.run_to_table(stream, out, checkpoint, mode).awaitTermination()
    return spark.read.parquet(out)


@query(
    o.with_(o.BASE)
    + f"""SELECT local_date, team_id, tool, {", ".join(f"sum({t})::BIGINT AS {t}" for t in TOKENS)},
  count(*) AS usage_event_count FROM base GROUP BY 1,2,3"""
)
def stream_daily_rollup(spark, sf_dir):
    stream = _event_stream(spark, sf_dir, ("event_ts", "team_id", "tool", *TOKENS))
    updates = _finished(running.stream_daily_rollup(stream, d.ZONE), spark, "update")
    return stream_ingest.latest_only(updates, ["local_date", "team_id", "tool"])


@query(
    o.with_(o.BASE, o.UPLOADS)
    + """SELECT team_id, user_id, device_id, upload_time AS last_upload_at, status AS latest_status, accepted AS latest_accepted,
  duplicate AS latest_duplicate, rejected AS latest_rejected FROM (SELECT *, row_number() OVER (
  PARTITION BY team_id, user_id, device_id ORDER BY upload_time DESC) AS nth FROM uploads) WHERE nth=1"""
)
def stream_upload_health(spark, sf_dir):
    path = scratch_dir(spark, "stream-source")
    source = _uploads(spark, sf_dir)
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).parquet(path)
    updates = _finished(running.stream_upload_health(stream), spark, "update")
    return stream_ingest.latest_only(updates, list(DEVICE))


@query(
    o.with_(o.BASE, "u AS (SELECT * FROM base)", o.rollup(o.TEAM_SESSION, o.TEAM_SESSION))
    + f"SELECT {_columns(o.TEAM_SESSION)}, active_seconds, usage_event_count FROM r"
)
def stream_active_time(spark, sf_dir):
    """Session windows summed per session must equal the batch metric."""
    stream = _event_stream(spark, sf_dir, ("event_ts", *TEAM.session))
    # Append mode would hold back stretches still open at the end of the table.
    batches = _finished(running.stream_active_time(stream, "0 seconds"), spark, "complete")
    last = batches.agg(F.max("batch_id").alias("batch_id"))
    return batches.join(last, "batch_id", "left_semi").groupBy(*TEAM.session).agg(
        F.sum("active_seconds").alias("active_seconds"),
        F.sum("usage_event_count").alias("usage_event_count"),
    )


@query(
    o.with_(o.BASE, "u AS (SELECT * FROM base)", o.rollup(o.TEAM_SESSION, o.TEAM_SESSION))
    + f"SELECT {_columns(o.TEAM_SESSION)}, active_seconds, usage_event_count, true AS some_closed, true AS some_open, 0::BIGINT AS late FROM r"
)
def stream_active_time_append(spark, sf_dir):
    """Closed stretches of an append-mode stream and those it holds back: together the batch metric."""
    columns = ("event_ts", *TEAM.session)
    stream = _event_stream(spark, sf_dir, columns)
    out, checkpoint = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-checkpoint")
    query = running.run_to_table(running.stream_active_time(stream, "2 hours"), out, checkpoint, "append")
    query.awaitTermination()
    closed = spark.read.parquet(out).drop("batch_id").withColumn("closed", F.lit(True))
    held = running.open_stretches(d.usage_base(spark, sf_dir).select(*columns), running.watermark_of(query))
    both = closed.unionByName(held.withColumn("closed", F.lit(False)))
    kinds = both.agg(F.max("closed").alias("c"), F.min("closed").alias("o"))
    return both.groupBy(*TEAM.session).agg(
        F.sum("active_seconds").alias("active_seconds"), F.sum("usage_event_count").alias("usage_event_count")
    ).select(
        "*", kinds.select("c").scalar().alias("some_closed"), (~kinds.select("o").scalar()).alias("some_open"),
        F.lit(running.late_rows(query)).cast("bigint").alias("late"),
    )


@query(o.with_(o.BASE, o.REPLAYED) + "SELECT team_id, event_key, total_tokens FROM base")
def stream_dedupe(spark, sf_dir):
    d.configure(spark)
    path = scratch_dir(spark, "stream-source")
    columns = (*DEVICE, "event_key", "event_ts", "total_tokens")
    source = d.usage_replayed(d.usage_base(spark, sf_dir)).select(*columns)
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).parquet(path)
    kept = _finished(stream_ingest.stream_dedupe(stream, "40 days"), spark, "append")
    return kept.select("team_id", "event_key", "total_tokens")


_STREAM_ACCEPTED = _ACCEPTED.replace("n=1 AND event_ts >= TIMESTAMP '2024-01-10'", "n=1")


@query(
    o.with_(*_CHECK_CHAIN, _VALID_SENT, _STREAM_ACCEPTED, _RESULTS)
    + """SELECT team_id, user_id, device_id, count(*) AS envelopes, sum(event_count)::BIGINT AS event_count,
  sum(accepted)::BIGINT AS accepted, sum(duplicate)::BIGINT AS duplicate, sum(rejected)::BIGINT AS rejected
FROM results WHERE code='ok' GROUP BY 1,2,3"""
)
def stream_ingest_envelopes(spark, sf_dir):
    """All envelopes through the streaming ingest; its ledger, per device."""
    base = d.usage_base(spark, sf_dir)
    drop, root = scratch_dir(spark, "drop"), scratch_dir(spark, "store")
    d.envelopes(base).write.parquet(drop)
    tables = jobs.Tables(root)
    bindings = scratch_dir(spark, "registry")
    d.registry(base).write.parquet(bindings)
    started = stream_ingest.stream_ingest_envelopes(
        spark, drop, bindings, tables, d.ZONE, scratch_dir(spark, "stream-checkpoint")
    )
    started.awaitTermination()
    return jobs.read_runs(spark, tables.uploads, jobs.UPLOAD_SCHEMA, monthly=False).groupBy(*DEVICE).agg(
        F.count("*").alias("envelopes"),
        *[F.sum(c).alias(c) for c in ("event_count", "accepted", "duplicate", "rejected")],
    )


@query(
    o.with_(o.BASE)
    + """SELECT tool, count(*) AS events, sum(total_tokens)::BIGINT AS total_tokens FROM (
  SELECT 'claude-code' AS tool, i+o_+r AS total_tokens FROM (
    SELECT input_tokens AS i, output_tokens AS o_, reasoning_output_tokens AS r, * FROM base)
  WHERE input_tokens>0 OR cached_input_tokens>0 OR output_tokens>0 OR reasoning_output_tokens>0) GROUP BY tool"""
)
def incremental_refresh(spark, sf_dir):
    """Flat log files written from events, refreshed twice: the second run adds nothing."""
    base = d.usage_base(spark, sf_dir)
    logs, root = scratch_dir(spark, "logs"), scratch_dir(spark, "store")
    flat = F.to_json(
        F.struct(
            F.concat("session_id", F.lit("-"), F.col("event_id").cast("string")).alias("session_id"),
            "model",
            canonical_instant(F.col("event_ts")).alias("time"),
            *TOKENS[:4],
        )
    )
    base.select(flat.alias("value")).write.text(f"{logs}/raw")
    _as_logs(spark, f"{logs}/raw")
    tables = jobs.Tables(root)
    for run_id in (1, 2):
        jobs.incremental_refresh(
            spark, None, logs, tables, d.ZONE, run_id, datetime(2024, 1, 31, 0, run_id)
        )
    return (
        jobs.read_runs(spark, tables.events, jobs.LOCAL_SCHEMA)
        .groupBy("tool")
        .agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens"))
    )

