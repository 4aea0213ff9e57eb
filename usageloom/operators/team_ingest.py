"""One ingest run over uploaded envelopes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.functions.instants import local_date
from usageloom.model import DEVICE, EVENT_COLUMNS, TEAM_EVENT_COLUMNS
from usageloom.operators.gate import envelope_code, screen_events, too_many_chars
from usageloom.operators.idempotent import Stored, insert_new_events
from usageloom.operators.registry import resolve_device
from usageloom.session import stage
from usageloom.sources.envelopes import envelope_events, open_envelopes

EVENT_IDENTITY = (*DEVICE, "event_key")
ARRIVAL = ("received_at", "envelope_id", "arrival", "position")


@dataclass(frozen=True)
class IngestRun:
    """The accepted events of a batch, and what is needed to report on it."""

    checked: DataFrame
    screened: DataFrame
    accepted: DataFrame

    @property
    def new_events(self) -> DataFrame:
        """Rows to append to the fact."""
        return self.accepted.select(*TEAM_EVENT_COLUMNS)

    @property
    def results(self) -> DataFrame:
        return self.results_given(self.accepted)

    def results_given(self, accepted: DataFrame) -> DataFrame:
        """One result per arrival of an envelope, from the accepted events or their stored copy.

        Duplicates are valid less accepted, so copies of a hot key meet in an
        aggregate and never in one task's window.
        """
        present = F.col("event_text_present")
        tallies = self.screened.groupBy("envelope_id", "arrival").agg(
            F.count_if(present).alias("event_count"),
            F.count_if(present & F.col("reject_reason").isNotNull()).alias("rejected"),
        )
        counted = accepted.groupBy("envelope_id", "arrival").agg(F.count(F.lit(1)).alias("accepted"))
        zero = F.lit(0).cast("bigint")
        duplicate = (
            F.coalesce("event_count", zero)
            - F.coalesce("rejected", zero)
            - F.coalesce("accepted", zero)
        )
        return (
            self.checked.join(tallies, ["envelope_id", "arrival"], "left")
            .join(counted, ["envelope_id", "arrival"], "left")
            .select(
                "envelope_id",
                "token_hash",
                *[F.col(f"bound_{c}").alias(c) for c in DEVICE],
                "uploaded_at",
                "code",
                F.coalesce("event_count", zero).alias("event_count"),
                F.coalesce("accepted", zero).alias("accepted"),
                duplicate.alias("duplicate"),
                F.coalesce("rejected", zero).alias("rejected"),
            )
        )


def check_envelopes(envelopes: DataFrame, registry: DataFrame) -> DataFrame:
    """Opened, resolved envelopes with the ``code`` of the first failed guard.

    ``arrival`` tells repeats of one envelope in a batch apart: a retry is an
    upload of its own, whose events are duplicates.
    """
    numbered = envelopes.withColumn("arrival", F.monotonically_increasing_id())
    sized = numbered.withColumn("too_long", too_many_chars(F.col("body")))
    return resolve_device(open_envelopes(sized), registry).withColumn("code", envelope_code())


def attribute_events(screened: DataFrame, zone: str) -> DataFrame:
    """Team, user and device come from the token's binding, never from the client."""
    return screened.select(
        "envelope_id",
        "arrival",
        "position",
        *[F.col(f"bound_{c}").alias(c) for c in DEVICE],
        *[
            local_date(F.col("event_ts"), zone).alias(c) if c == "local_date" else F.col(c)
            for c in EVENT_COLUMNS
        ],
        F.col("uploaded_at").alias("received_at"),
    )


def screened_batch(checked: DataFrame) -> DataFrame:
    """Events of the envelopes that passed, each with its reject reason or none.

    The raw event text ends here; only canonical columns go on.
    """
    events = envelope_events(checked.filter(F.col("code") == "ok"))
    present = F.col("event_text").isNotNull()
    return (
        screen_events(events)
        .withColumn("event_text_present", present)
        .select(
            "envelope_id",
            "arrival",
            "position",
            "uploaded_at",
            *[f"bound_{c}" for c in DEVICE],
            *[c for c in EVENT_COLUMNS if c != "local_date"],
            "reject_reason",
            "event_text_present",
        )
    )


def ingest_checked(
    checked: DataFrame,
    screened: DataFrame,
    stored: Stored,
    zone: str,
    keep: Callable[[DataFrame], DataFrame] = lambda first: first,
) -> IngestRun:
    """Find a screened batch's new events; the first arrival of a new key is accepted."""
    valid = screened.filter(F.col("event_text_present") & F.col("reject_reason").isNull())
    accepted = insert_new_events(
        attribute_events(valid, zone), stored, key=EVENT_IDENTITY, order=ARRIVAL, keep=keep
    )
    return IngestRun(checked, screened, accepted)


def ingest_team_batch(
    envelopes: DataFrame, registry: DataFrame, stored: Stored, zone: str
) -> IngestRun:
    """Guard, screen and attribute a batch, without writing to the store.

    ``arrival`` is numbered by partition and row, which a second computation may
    deal differently; so opened envelopes are staged before they are used twice.
    """
    spark = envelopes.sparkSession
    checked = stage(spark, check_envelopes(envelopes, registry).drop("body"), "opened")
    screened = stage(spark, screened_batch(checked), "screened")
    return ingest_checked(checked.drop("events"), screened, stored, zone)


def ledger_rows(results: DataFrame, zone: str, storage_error: str | None = None) -> DataFrame:
    """Upload ledger entries; refused envelopes leave none.

    With ``storage_error`` the run failed after the guards: the rows say so and
    carry no counts.
    """
    failed = storage_error is not None
    zero = F.lit(0).cast("bigint")
    return results.filter(F.col("code") == "ok").select(
        *DEVICE,
        local_date(F.col("uploaded_at"), zone).alias("upload_date"),
        F.col("uploaded_at").alias("upload_time"),
        "event_count",
        *[(zero if failed else F.col(c)).alias(c) for c in ("accepted", "duplicate", "rejected")],
        F.lit("error" if failed else "ok").alias("status"),
        F.lit(storage_error or "").alias("message"),
    )


def append_upload_ledger(ledger: DataFrame, results: DataFrame, zone: str) -> DataFrame:
    return ledger.unionByName(ledger_rows(results, zone))
