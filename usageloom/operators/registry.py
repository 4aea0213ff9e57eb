"""Device registry: lookup, enrichment, upkeep and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.functions.texts import is_blank, masked
from usageloom.model import DEVICE
from usageloom.operators.idempotent import first_per_key, latest_per_key


def resolve_device(envelopes: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the binding of each envelope's token; null where there is none.

    A plain left join: the planner broadcasts the registry while it is small
    and shuffles both sides, splitting hot tokens, once it is not.
    """
    bound = registry.select(
        F.col("token_hash"),
        *[F.col(c).alias(f"bound_{c}") for c in DEVICE],
        F.col("status").alias("bound_status"),
    )
    hashed = envelopes.withColumn("token_hash", F.sha2(F.coalesce("token", F.lit("")), 256))
    return hashed.join(bound, "token_hash", "left")


def device_names(registry: DataFrame) -> DataFrame:
    """One display name per device; the smallest token hash wins."""
    return first_per_key(registry, DEVICE, ("token_hash",)).select(
        *DEVICE, F.col("display_name").alias("device_name")
    )


def enrich_device(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """User and device display names; blank or missing names fall back to the ids."""
    named = rows.join(device_names(registry), list(DEVICE), "left")
    blank = is_blank(F.col("device_name"))
    return named.select(
        *rows.columns,
        F.when(blank, F.col("user_id")).otherwise(F.col("device_name")).alias("user_display_name"),
        F.when(blank, F.col("device_id")).otherwise(F.col("device_name")).alias("device_display_name"),
    )


def replacements(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of each token as its binding; a known token keeps created_at and last_seen_at."""
    kept = registry.select(
        "token_hash", F.col("created_at").alias("_created"), F.col("last_seen_at").alias("_seen")
    )
    latest = latest_per_key(changes, ("token_hash",), ("created_at",))
    return latest.join(kept, "token_hash", "left").select(
        *[c for c in registry.columns if c not in ("created_at", "last_seen_at")],
        F.coalesce("_created", "created_at").alias("created_at"),
        F.col("_seen").alias("last_seen_at"),
    )


def upsert_registry(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the binding of known tokens, keeping created_at and last_seen_at."""
    return remove_registry(registry, changes).unionByName(replacements(registry, changes))


def remove_registry(registry: DataFrame, removed: DataFrame) -> DataFrame:
    return registry.join(removed.select("token_hash"), "token_hash", "left_anti")


def left_of(registry: DataFrame, removed: DataFrame) -> DataFrame:
    """The stored bindings of tokens to remove."""
    return registry.join(removed.select("token_hash"), "token_hash", "left_semi")


def register_tokens(tokens: DataFrame) -> DataFrame:
    """Bindings to store for new tokens: hash and preview replace the token itself."""
    return tokens.select(
        F.sha2("token", 256).alias("token_hash"),
        masked(F.col("token")).alias("token_preview"),
        *[c for c in tokens.columns if c != "token"],
    )


def touch_last_seen(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Move last_seen_at forward to each token's latest successful upload, never back."""
    latest = seen.groupBy("token_hash").agg(F.max("uploaded_at").alias("_latest"))
    return registry.join(latest, "token_hash", "left").select(
        *[
            F.greatest("_latest", "last_seen_at").alias(c) if c == "last_seen_at" else F.col(c)
            for c in registry.columns
        ]
    )


def registry_listing(registry: DataFrame) -> DataFrame:
    """Bindings in listing order; hashes stay inside."""
    return registry.orderBy("team_id", "user_id", "device_id", "created_at", "token_hash").select(
        *DEVICE, "display_name", "status", "created_at", "last_seen_at", "token_preview"
    )
