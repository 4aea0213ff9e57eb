"""Message log and telemetry files: per-message token usage in three shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.instants import canonical_instant, parse_instant
from usageloom.functions.texts import (
    has_positive_usage,
    is_blank,
    known_model,
    leading_digits,
    unreadable,
)
from usageloom.model import TOKENS, UNKNOWN
from usageloom.sources.lines import session_lines

# Counters of a nested usage object.
USAGE_COUNTERS = (
    "input_tokens",
    "cache_creation_input_tokens",
    "cache_read_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)

_NESTED_USAGE = "struct<" + ", ".join(f"{c} string" for c in USAGE_COUNTERS) + ">"

# Only usage metadata is read from a line, never message contents.
RECORD_SCHEMA = (
    "sessionId string, session_id string, timestamp string, time string, uuid string, "
    f"model string, message struct<id string, model string, usage {_NESTED_USAGE}>, "
    f"toolUseResult struct<model string, usage {_NESTED_USAGE}>, "
    + ", ".join(f"{t} string" for t in TOKENS)
)

# What a source mode says about where and how usage was measured.
SOURCE_MODES = {
    "local": ("local_jsonl", "reported"),
    "otel": ("otel_metric", "reported"),
    "hook": ("hook_metadata", "estimated"),
    "fixture": ("fixture", "reported"),
}


def tag_source(df: DataFrame, mode: str) -> DataFrame:
    """Add source_kind and source_quality; ``snapshot`` marks the snapshot log."""
    if mode == "snapshot":
        kind, quality = "local_jsonl", "derived"
    elif mode in SOURCE_MODES:
        kind, quality = SOURCE_MODES[mode]
    else:
        raise ValueError("mode must be one of local, otel, hook, fixture or snapshot")
    return df.withColumn("source_kind", F.lit(kind)).withColumn("source_quality", F.lit(quality))


def message_token_normalise(raw: Mapping[str, Column]) -> tuple[Column, ...]:
    """The five counters from those of a nested usage object, null where absent.

    Cache creation and cache reads are part of gross input.
    """
    read = {c: F.coalesce(raw[c], F.lit(0).cast("bigint")) for c in USAGE_COUNTERS}
    cached = read["cache_creation_input_tokens"] + read["cache_read_input_tokens"]
    gross = read["input_tokens"] + cached
    output, reasoning = read["output_tokens"], read["reasoning_output_tokens"]
    total = F.coalesce(raw["total_tokens"], gross + output + reasoning)
    return gross, cached, output, reasoning, total


def flat_tokens(raw: Mapping[str, Column]) -> tuple[Column, ...]:
    """The five counters of a flat line, whose input is gross already."""
    zero = F.lit(0).cast("bigint")
    gross, cached, output, reasoning = [F.coalesce(raw[t], zero) for t in TOKENS[:4]]
    total = F.coalesce(raw["total_tokens"], gross + output + reasoning)
    return gross, cached, output, reasoning, total


def _read(section: str, prefix: str, names: Sequence[str]) -> list[Column]:
    """A number per counter of a parsed section, and whether one is unreadable."""
    texts = [leading_digits(F.col(f"{section}.{n}")) for n in names]
    broken = reduce(or_, [unreadable(t) for t in texts])
    numbers = [t.try_cast("bigint").alias(f"{prefix}{n}") for t, n in zip(texts, names)]
    return [*numbers, broken.alias(f"{prefix}broken")]


def is_message_candidate(line: Column) -> Column:
    return line.contains('_tokens"') | line.contains('"model"')


def message_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return session_lines(spark, paths, keep=is_message_candidate(F.col("line")))


def message_log_records(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) to usage rows.

    Shapes are tried in order: message, tool result, flat. A shape without
    positive usage falls through to the next one; an unreadable number or time
    drops the line at the shape that met it (``dropped``). ``line_model`` is the
    known model a line mentions, for the backfill.
    """
    parsed = lines.filter(is_message_candidate(F.col("line"))).select(
        "path", "line_no", F.from_json("line", RECORD_SCHEMA).alias("r")
    )
    session, timestamp = F.col("r.sessionId"), F.col("r.timestamp")
    nested = ~is_blank(session) & ~is_blank(timestamp)
    flat_session = F.coalesce("r.session_id", "r.sessionId")
    flat_time = F.coalesce("r.timestamp", "r.time")
    read = parsed.select(
        "path",
        "line_no",
        "r",
        (nested & F.col("r.message.usage").isNotNull()).alias("_is_message"),
        (nested & F.col("r.toolUseResult.usage").isNotNull()).alias("_is_result"),
        (~is_blank(flat_session) & ~is_blank(flat_time)).alias("_is_flat"),
        parse_instant(timestamp).alias("_ts"),
        parse_instant(flat_time).alias("_flat_ts"),
        *_read("r.message.usage", "_m_", USAGE_COUNTERS),
        *_read("r.toolUseResult.usage", "_t_", USAGE_COUNTERS),
        *_read("r", "_f_", TOKENS),
    )

    def raw(prefix: str, names: Sequence[str]) -> dict[str, Column]:
        return {n: F.col(f"{prefix}{n}") for n in names}

    message = message_token_normalise(raw("_m_", USAGE_COUNTERS))
    result = message_token_normalise(raw("_t_", USAGE_COUNTERS))
    flat = flat_tokens(raw("_f_", TOKENS))

    def unusable(prefix: str, ts: str) -> Column:
        return F.col(ts).isNull() | F.coalesce(f"{prefix}broken", F.lit(False))

    shape = (
        F.when(F.col("_is_message") & unusable("_m_", "_ts"), "failed")
        .when(F.col("_is_message") & has_positive_usage(message), "message")
        .when(F.col("_is_result") & unusable("_t_", "_ts"), "failed")
        .when(F.col("_is_result") & has_positive_usage(result), "tool_result")
        .when(F.col("_is_flat") & unusable("_f_", "_flat_ts"), "failed")
        .when(F.col("_is_flat") & has_positive_usage(flat), "flat")
    )
    shaped = read.withColumn("shape", shape)

    def by_shape(of_message: Column, of_result: Column, of_flat: Column) -> Column:
        return (
            F.when(F.col("shape") == "message", of_message)
            .when(F.col("shape") == "tool_result", of_result)
            .when(F.col("shape") == "flat", of_flat)
        )

    ts = by_shape(F.col("_ts"), F.col("_ts"), F.col("_flat_ts"))
    message_id = F.when(~is_blank(F.col("r.message.id")), F.col("r.message.id"))
    given = by_shape(message_id, F.col("r.uuid"), F.lit(None).cast("string"))
    model = by_shape(
        F.coalesce("r.message.model", "r.model"),
        F.coalesce("r.toolUseResult.model", "r.model"),
        F.col("r.model"),
    )
    row = F.struct(
        "path",
        "line_no",
        "shape",
        (F.col("shape") == "failed").alias("dropped"),
        by_shape(session, session, flat_session).alias("session_id"),
        F.coalesce(model, F.lit(UNKNOWN)).alias("model"),
        ts.alias("event_ts"),
        F.coalesce(given, canonical_instant(ts)).alias("identity"),
        F.coalesce(
            known_model(F.col("r.message.model")),
            known_model(F.col("r.toolUseResult.model")),
            known_model(F.col("r.model")),
        ).alias("line_model"),
        *[by_shape(m, r, f).alias(t) for m, r, f, t in zip(message, result, flat, TOKENS)],
    )
    # One row in, one row out. The generator keeps filters on the shape above it;
    # below, each would be repeated in terms of every counter.
    return shaped.select(F.inline(F.array(row)))


def usage_telemetry(spark: SparkSession, paths: str | list[str], mode: str) -> DataFrame:
    """Usage rows of telemetry, hook or fixture files, tagged with their mode."""
    return tag_source(message_log_records(message_log_lines(spark, paths)), mode)
