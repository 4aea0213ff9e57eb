"""Uploaded envelopes: one JSON document per device upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_SCHEMA = (
    "collector_version string, client_user_id string, client_device_id string, "
    "events array<string>"
)


def read_envelopes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(envelope_id, token, uploaded_at, body) from a drop directory of JSON lines.

    Each line is ``{"token", "uploaded_at", "body"}``: the token travels beside
    the document, as it does in a request header.
    """
    schema = "token string, uploaded_at timestamp, body string"
    return (
        spark.read.schema(schema)
        .json(paths)
        .select(
            F.sha2(
                F.concat_ws("|", "token", F.col("uploaded_at").cast("string"), "body"), 256
            ).alias("envelope_id"),
            "token",
            "uploaded_at",
            "body",
        )
    )


def open_envelopes(envelopes: DataFrame) -> DataFrame:
    """Parse bodies; ``events`` holds the raw text of each event object, null if no array."""
    opened = envelopes.withColumn("_e", F.from_json("body", ENVELOPE_SCHEMA))
    objects = F.filter("_e.events", lambda e: e.startswith("{"))
    return opened.select(
        *envelopes.columns,
        F.coalesce("_e.client_user_id", F.lit("")).alias("client_user_id"),
        F.coalesce("_e.client_device_id", F.lit("")).alias("client_device_id"),
        objects.alias("events"),
    )


def envelope_events(opened: DataFrame) -> DataFrame:
    """One row per event with its position; an empty envelope keeps one null row."""
    kept = [c for c in opened.columns if c not in ("events", "body")]
    return opened.select(*kept, F.posexplode_outer("events").alias("position", "event_text"))
