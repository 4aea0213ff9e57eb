"""Guards of an upload, for whole envelopes and for single events."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.functions.instants import parse_instant
from usageloom.functions.texts import (
    has_positive_usage,
    is_blank,
    is_known_tool,
    leading_digits,
    mentions_forbidden,
    or_unknown,
    unreadable,
    utf16_length,
)
from usageloom.model import MAX_ENVELOPE_CHARS, MAX_ENVELOPE_EVENTS, TOKENS, UNKNOWN

EVENT_SCHEMA = (
    "event_key string, tool string, session_id string, model string, timestamp string, "
    "source_kind string, source_quality string, " + ", ".join(f"{t} string" for t in TOKENS)
)


def identity_conflict() -> Column:
    """A non-blank client id must equal the token's binding."""
    user = ~is_blank(F.col("client_user_id")) & (F.col("client_user_id") != F.col("bound_user_id"))
    device = ~is_blank(F.col("client_device_id")) & (
        F.col("client_device_id") != F.col("bound_device_id")
    )
    return user | device


def too_many_chars(body: Column) -> Column:
    """Counts UTF-16 units, looking closer only where the answer is in doubt."""
    length = F.length(body)
    return F.coalesce(
        F.when(length > MAX_ENVELOPE_CHARS, True)
        .when(length * 2 <= MAX_ENVELOPE_CHARS, False)
        .otherwise(utf16_length(body) > MAX_ENVELOPE_CHARS),
        F.lit(False),
    )


def envelope_code() -> Column:
    """The first guard an opened and resolved envelope fails, else ``ok``."""
    return (
        F.when(F.col("too_long"), "payload_too_large")
        .when(is_blank(F.col("token")) | F.col("bound_status").isNull(), "unauthorized")
        .when(F.col("bound_status") != "active", "forbidden")
        .when(identity_conflict(), "identity_conflict")
        .when(F.col("events").isNull(), "invalid_payload")
        .when(F.size("events") > MAX_ENVELOPE_EVENTS, "payload_too_large")
        .otherwise("ok")
    )


def parse_events(events: DataFrame) -> DataFrame:
    """Raw event text to typed columns; counters stay null where absent or broken."""
    text = F.col("event_text")
    digits = [leading_digits(F.col(f"_e.{t}")) for t in TOKENS]
    broken = reduce(or_, [F.coalesce(unreadable(x), F.lit(False)) for x in digits])
    return events.withColumn("_e", F.from_json(text, EVENT_SCHEMA)).select(
        *events.columns,
        *[
            F.col(f"_e.{c}").alias(c)
            for c in ("event_key", "tool", "session_id", "model", "source_kind", "source_quality")
        ],
        F.col("_e.timestamp").alias("timestamp_text"),
        parse_instant(F.col("_e.timestamp")).alias("event_ts"),
        *[x.try_cast("bigint").alias(t) for x, t in zip(digits, TOKENS)],
        broken.alias("broken_counter"),
        mentions_forbidden(text).alias("forbidden"),
    )


def canonical_defaults(events: DataFrame) -> DataFrame:
    """Fill in absent model, counters, total and source metadata."""
    zero = F.lit(0).cast("bigint")
    filled = {t: F.coalesce(t, zero) for t in TOKENS[:4]}
    total = F.coalesce(
        F.col("total_tokens"),
        filled["input_tokens"] + filled["output_tokens"] + filled["reasoning_output_tokens"],
    )
    return events.withColumns(
        {
            "model": F.coalesce("model", F.lit(UNKNOWN)),
            "total_tokens": total,
            **filled,
            "source_kind": or_unknown(F.col("source_kind")),
            "source_quality": or_unknown(F.col("source_quality")),
        }
    )


def reject_reason() -> Column:
    """Why a parsed event with defaults is refused, null when it is not."""
    return (
        F.when(is_blank(F.col("event_key")), "blank_event_key")
        .when(~is_known_tool(F.col("tool")), "unknown_tool")
        .when(is_blank(F.col("session_id")), "blank_session")
        .when(is_blank(F.col("timestamp_text")), "blank_timestamp")
        .when(F.col("forbidden"), "forbidden_content")
        .when(F.col("event_ts").isNull(), "bad_timestamp")
        .when(F.col("broken_counter"), "bad_number")
        .when(~has_positive_usage(), "no_usage")
    )


def screen_events(events: DataFrame) -> DataFrame:
    """Parsed events with defaults and a ``reject_reason``."""
    return canonical_defaults(parse_events(events)).withColumn("reject_reason", reject_reason())


def privacy_screen(events: DataFrame, text: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows without forbidden content, projected to an allow list."""
    return events.filter(~mentions_forbidden(F.col(text))).select(*allowed)
