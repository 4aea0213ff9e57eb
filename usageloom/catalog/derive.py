"""Usage tables derived by Spark from the ``events`` test table.

Every derived table grows with ``events``; nothing is sampled or made up.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usageloom.functions.instants import canonical_instant, local_date
from usageloom.functions.texts import is_known_tool
from usageloom.model import DEVICE, EVENT_COLUMNS, TOKENS
from usageloom.session import configure

ZONE = "Asia/Shanghai"
AS_OF = date(2024, 1, 17)
AS_OF_INSTANT = datetime(2024, 1, 17, 4, 0, 0, tzinfo=timezone.utc)


# Column types of the table; stating them spares a job that reads file footers.
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)


def usage_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team events, unknown tool included, with ``event_id`` and ``k`` for further tables."""
    configure(spark)
    raw = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    shifted = raw.selectExpr(
        "event_id",
        "CAST(ts AS timestamp) AS event_ts",
        f"from_utc_timestamp(CAST(ts AS timestamp), '{ZONE}') AS lts",
        "user_id AS uid",
        "event_type",
        "CAST(get_json_object(props, '$.k') AS bigint) AS k",
        "floor(value * 10) AS i",
        "floor(value * 3) AS o",
    )
    return shifted.selectExpr(
        "concat('ev-', event_id) AS event_key",
        "concat('team-', uid % 3) AS team_id",
        "concat('user-', uid) AS user_id",
        "concat('device-', uid * 2 + day(lts) % 2) AS device_id",
        """CASE WHEN event_type IN ('view', 'click') THEN 'codex'
                WHEN event_type IN ('signup', 'purchase') THEN 'claude-code'
                ELSE 'other' END AS tool""",
        "concat('s-', uid, '-', replace(CAST(to_date(lts) AS string), '-', '')) AS session_id",
        "CASE WHEN k % 10 = 9 THEN 'unknown' ELSE concat('model-', k % 5) END AS model",
        "event_ts",
        "to_date(lts) AS local_date",
        "i AS input_tokens",
        "CASE WHEN k >= 95 THEN i + k ELSE (i * k) div 100 END AS cached_input_tokens",
        "o AS output_tokens",
        "(o * (k % 7)) div 10 AS reasoning_output_tokens",
        "i + o + (o * (k % 7)) div 10 AS total_tokens",
        "CASE k % 3 WHEN 0 THEN 'local_jsonl' WHEN 1 THEN 'otel_metric' ELSE '' END AS source_kind",
        "CASE k % 3 WHEN 0 THEN 'derived' WHEN 1 THEN 'reported' ELSE '' END AS source_quality",
        "event_id",
        "k",
        "uid",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of known tools: what reports run over."""
    return usage_base(spark, sf_dir).filter(is_known_tool(F.col("tool")))


def usage_replayed(base: DataFrame) -> DataFrame:
    """Every twentieth event arrives twice under the same key."""
    return base.unionByName(base.filter(F.col("event_id") % 20 == 0))


def usage_calls(base: DataFrame) -> DataFrame:
    """Every twenty-fifth event arrives again under another key: one call, two events."""
    again = base.filter(F.col("event_id") % 25 == 0).withColumn(
        "event_key", F.concat("event_key", F.lit("-b"))
    )
    return base.unionByName(again)


def usage_dec(base: DataFrame) -> DataFrame:
    """Odd events moved 31 days back, so that the previous month has data."""
    odd = F.col("event_id") % 2 == 1
    earlier = F.col("event_ts") - F.expr("INTERVAL 31 DAYS")
    moved = F.when(odd, earlier).otherwise(F.col("event_ts"))
    return base.withColumn("event_ts", moved).withColumn(
        "local_date", local_date(F.col("event_ts"), ZONE)
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot log per session: running totals that restart at local noon.

    Each seventh event repeats its line, which must not add usage.
    """
    base = usage_base(spark, sf_dir)
    half = (F.hour(F.from_utc_timestamp("event_ts", ZONE)) >= 12).cast("int")
    order = ("event_ts", "event_id")
    running = (
        Window.partitionBy("session_id", "half")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = base.withColumn("half", half).select(
        "session_id",
        "event_ts",
        "event_id",
        "k",
        F.lit(0).alias("copy"),
        F.struct(*[F.sum(t).over(running).alias(t) for t in TOKENS]).alias("cumulative"),
        F.when(F.col("event_id") % 4 == 0, F.col("model")).alias("context_model"),
    )
    repeated = summed.filter(F.col("event_id") % 7 == 0).withColumn("copy", F.lit(1))
    line = Window.partitionBy("session_id").orderBy(*order, "copy")
    return summed.unionByName(repeated).select(
        F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("path"),
        F.row_number().over(line).cast("bigint").alias("line_no"),
        "*",
    )


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as decoded log records: model context on token lines, no session lines."""
    return snapshots(spark, sf_dir).select(
        "path",
        "line_no",
        F.lit("token_count").alias("kind"),
        F.lit(None).cast("string").alias("session_meta_id"),
        "context_model",
        "event_ts",
        F.lit(None).cast("string").alias("error"),
        "cumulative",
        "event_id",
    )


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as raw log lines: a model line before a token line where it is known.

    Every thirteenth event's time is unreadable, every seventeenth event's line
    is broken JSON.
    """
    rows = snapshots(spark, sf_dir)
    event_id = F.col("event_id")
    time = F.when(event_id % 13 == 0, "yesterday").otherwise(canonical_instant(F.col("event_ts")))
    usage_text = F.struct(F.col("cumulative").alias("total_token_usage"))
    token = F.to_json(
        F.struct(
            time.alias("timestamp"),
            F.lit("event_msg").alias("type"),
            F.struct(F.lit("token_count").alias("type"), usage_text.alias("info")).alias("payload"),
        )
    )
    token_line = F.when(event_id % 17 == 0, F.substring(token, 1, 60)).otherwise(token)
    context = F.to_json(
        F.struct(
            F.lit("turn_context").alias("type"),
            F.struct(F.col("context_model").alias("model")).alias("payload"),
        )
    )
    pair = F.array(
        F.struct(F.lit(1).alias("part"), context.alias("line")),
        F.struct(F.lit(2).alias("part"), token_line.alias("line")),
    )
    return (
        rows.select("path", "line_no", "context_model", F.explode(pair).alias("p"))
        .filter((F.col("p.part") == 2) | F.col("context_model").isNotNull())
        .select("path", (F.col("line_no") * 2 + F.col("p.part") - 2).alias("line_no"), "p.line")
    )


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message-log lines, a file per user: shape by event, replays, unreadable lines.

    Event ids pick the shape: 0 message, 1 tool result, 2 flat without a total.
    Each twentieth event is written twice, each nineteenth has a broken time.
    """
    base = usage_replayed(usage_base(spark, sf_dir))
    time = F.when(F.col("event_id") % 19 == 0, "soon").otherwise(
        canonical_instant(F.col("event_ts"))
    )
    model = F.when(F.col("model") != "unknown", F.col("model"))
    nested = F.struct(
        (F.col("input_tokens")).alias("input_tokens"),
        F.col("k").alias("cache_creation_input_tokens"),
        F.col("cached_input_tokens").alias("cache_read_input_tokens"),
        "output_tokens",
        "reasoning_output_tokens",
    )
    message = F.struct(
        F.col("session_id").alias("sessionId"),
        time.alias("timestamp"),
        F.struct(
            F.concat(F.lit("msg-"), F.col("event_id").cast("string")).alias("id"),
            model.alias("model"),
            F.lit("never read").alias("content"),
            nested.alias("usage"),
        ).alias("message"),
    )
    tool_result = F.struct(
        F.col("session_id").alias("sessionId"),
        time.alias("timestamp"),
        F.concat(F.lit("u-"), F.col("event_id").cast("string")).alias("uuid"),
        F.struct(model.alias("model"), nested.alias("usage")).alias("toolUseResult"),
    )
    flat = F.struct(
        F.col("session_id").alias("session_id"),
        model.alias("model"),
        time.alias("time"),
        *TOKENS[:4],
    )
    shape = F.col("event_id") % 3
    line = (
        F.when(shape == 0, F.to_json(message))
        .when(shape == 1, F.to_json(tool_result))
        .otherwise(F.to_json(flat))
    )
    order = Window.partitionBy("uid").orderBy("event_ts", "event_id")
    return base.select(
        F.concat(F.lit("/messages/"), "user_id", F.lit(".jsonl")).alias("path"),
        F.row_number().over(order).cast("bigint").alias("line_no"),
        line.alias("line"),
    )


def registry(base: DataFrame) -> DataFrame:
    """Device registry: some devices absent, inactive, unnamed or bound twice."""
    devices = base.select(*DEVICE, "uid").distinct().filter("uid % 11 <> 0")
    tokens = """explode(CASE WHEN uid % 5 = 0
        THEN array(concat(device_id, '-token'), concat(device_id, '-second'))
        ELSE array(concat(device_id, '-token')) END) AS token"""
    return devices.selectExpr("*", tokens).selectExpr(
        "sha2(token, 256) AS token_hash",
        *DEVICE,
        "CASE WHEN uid % 4 = 0 THEN '' ELSE concat('Dev ', device_id) END AS display_name",
        """CASE WHEN uid % 13 = 0 THEN 'disabled' WHEN uid % 17 = 0 THEN 'revoked'
                ELSE 'active' END AS status""",
        "timestamp '2024-01-01 00:00:00' AS created_at",
        "CAST(NULL AS timestamp) AS last_seen_at",
        "concat(left(token, 6), '****', right(token, 4)) AS token_preview",
    )


def envelope_rows(base: DataFrame) -> DataFrame:
    """Events to upload with their envelope: one per device and local date."""
    return usage_replayed(base).select(
        "*",
        F.concat_ws("/", "device_id", F.col("local_date").cast("string")).alias("envelope_id"),
        F.concat("device_id", F.lit("-token")).alias("token"),
        F.when(F.col("uid") % 19 == 0, "intruder").otherwise(F.col("user_id")).alias(
            "client_user_id"
        ),
    )


def envelopes(base: DataFrame) -> DataFrame:
    """(envelope_id, token, uploaded_at, body): at most a device's events of one day each."""
    event = F.struct(
        "event_key",
        "tool",
        "session_id",
        "model",
        canonical_instant(F.col("event_ts")).alias("timestamp"),
        *TOKENS[:4],
        F.when(F.col("event_id") % 11 != 0, F.col("total_tokens")).alias("total_tokens"),
        F.when(F.col("source_kind") != "", F.col("source_kind")).alias("source_kind"),
        F.when(F.col("source_quality") != "", F.col("source_quality")).alias("source_quality"),
        F.when(F.col("event_id") % 23 == 0, F.lit("hidden")).alias("prompt"),
    )
    grouped = (
        envelope_rows(base)
        .groupBy("envelope_id", "token", "client_user_id", "device_id")
        .agg(
            F.max("event_ts").alias("uploaded_at"),
            F.sort_array(F.collect_list(F.struct("event_ts", "event_id", event.alias("e")))).alias(
                "events"
            ),
        )
    )
    body = F.to_json(
        F.struct(
            F.lit("0.1.0").alias("collector_version"),
            "client_user_id",
            F.col("device_id").alias("client_device_id"),
            F.transform("events", lambda x: x["e"]).alias("events"),
        )
    )
    return grouped.select("envelope_id", "token", "uploaded_at", body.alias("body"))


def uploads(base: DataFrame) -> DataFrame:
    """Upload ledger: one row per device and local date."""
    known = is_known_tool(F.col("tool"))
    replay = known & (F.col("event_id") % 20 == 0)
    return (
        base.groupBy(*DEVICE, F.col("local_date").alias("upload_date"))
        .agg(
            F.max("event_ts").alias("upload_time"),
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(known & ~replay).alias("accepted"),
            F.count_if(replay).alias("duplicate"),
            F.count_if(~known).alias("rejected"),
            F.when(F.max("k") == 99, "error").otherwise("ok").alias("status"),
        )
        .withColumn("message", F.lit(""))
    )


def manifest(base: DataFrame) -> DataFrame:
    """A log file per session: its size and time move as events arrive."""
    return base.groupBy("tool", F.concat(F.lit("/logs/"), "session_id").alias("path")).agg(
        F.sum("total_tokens").alias("size_bytes"),
        F.max("event_ts").alias("modified_at"),
        F.count(F.lit(1)).alias("last_line"),
        F.max("event_ts").alias("scanned_at"),
    )


def old_manifest(base: DataFrame) -> DataFrame:
    return manifest(base.filter(F.col("event_ts") < F.lit("2024-01-20 00:00:00").cast("timestamp")))


def cursors(base: DataFrame) -> DataFrame:
    """Upload cursors; every third user has none."""
    before = F.col("event_ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    return (
        base.filter(before & (F.col("uid") % 3 != 0))
        .groupBy("user_id", "device_id")
        .agg(F.max(F.struct("event_ts", "event_key")).alias("c"))
        .select(
            "user_id",
            "device_id",
            F.col("c.event_ts").alias("cursor_ts"),
            F.col("c.event_key").alias("cursor_key"),
        )
    )


def team_events(base: DataFrame) -> DataFrame:
    """Base rows in the layout of the stored team fact."""
    return base.select(*DEVICE, *EVENT_COLUMNS, F.col("event_ts").alias("received_at"))
