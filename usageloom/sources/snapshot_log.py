"""Snapshot log: running token totals, one JSON record per line."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.instants import parse_instant
from usageloom.functions.texts import leading_digits, unreadable
from usageloom.model import TOKENS
from usageloom.sources.lines import session_lines

# Only these places of a record are read; numbers stay text until they are checked.
RECORD_SCHEMA = (
    "type string, timestamp string, id string, model string, "
    "payload struct<id string, model string, type string, "
    "info struct<total_token_usage struct<" + ", ".join(f"{t} string" for t in TOKENS) + ">>>"
)


def is_snapshot_candidate(line: Column) -> Column:
    """Cheap test before JSON parsing: most lines of a log carry no usage."""
    return (
        line.contains("session_meta") | line.contains("turn_context") | line.contains("token_count")
    )


def snapshot_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return session_lines(spark, paths, keep=is_snapshot_candidate(F.col("line")))


def snapshot_log_records(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) to typed rows; other record types are dropped.

    ``kind`` is ``session_meta``, ``turn_context`` or ``token_count``. A token
    row with an unreadable number or time keeps its ``error`` and no snapshot.
    """
    parsed = lines.filter(is_snapshot_candidate(F.col("line"))).select(
        "path", "line_no", F.from_json("line", RECORD_SCHEMA).alias("r")
    )
    usage = F.col("r.payload.info.total_token_usage")
    top = F.col("r.type")
    # The presence of a timestamp and of a totals object makes a token record;
    # a record lacking either is skipped without an error.
    is_token = (
        (top == "event_msg")
        & (F.col("r.payload.type") == "token_count")
        & F.col("r.timestamp").isNotNull()
        & usage.isNotNull()
    )
    kind = F.when(top.isin("session_meta", "turn_context"), top).when(is_token, "token_count")
    row = F.struct(
        "path",
        "line_no",
        kind.alias("kind"),
        F.coalesce("r.payload.id", "r.id").alias("_id"),
        F.coalesce("r.payload.model", "r.model").alias("_model"),
        F.when(is_token, parse_instant(F.col("r.timestamp"))).alias("_ts"),
        F.when(is_token, usage).alias("_usage"),
    )
    # One row in, one row out: the generator keeps the filter on the kind above
    # it; below, the line would be parsed again for every term of the filter.
    typed = parsed.select(F.inline(F.array(row))).filter(F.col("kind").isNotNull())
    token = F.col("kind") == "token_count"
    digits = {t: leading_digits(F.col(f"_usage.{t}")) for t in TOKENS}
    broken = reduce(or_, [F.coalesce(unreadable(x), F.lit(False)) for x in digits.values()])
    error = F.when(token & broken, "parse error: NumberFormatException").when(
        token & F.col("_ts").isNull(), "parse error: DateTimeParseException"
    )
    zero = F.lit(0).cast("bigint")
    cumulative = F.struct(
        *[F.coalesce(x.try_cast("bigint"), zero).alias(t) for t, x in digits.items()]
    )
    return typed.withColumn("error", error).select(
        "path",
        "line_no",
        "kind",
        F.when(F.col("kind") == "session_meta", F.col("_id")).alias("session_meta_id"),
        F.when(F.col("kind") == "turn_context", F.col("_model")).alias("context_model"),
        F.col("_ts").alias("event_ts"),
        "error",
        F.when(token & F.col("error").isNull(), cumulative).alias("cumulative"),
    )
