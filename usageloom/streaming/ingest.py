"""Continuous ingest of a drop directory of envelopes."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usageloom.model import DEVICE
from usageloom.plans.jobs import Tables, run_team_ingest

DROP_SCHEMA = "envelope_id string, token string, uploaded_at timestamp, body string"


#: Files that one micro-batch takes in.
FILES_PER_BATCH = 1_000


def stream_ingest_envelopes(
    spark: SparkSession,
    drop_dir: str,
    registry: str,
    tables: Tables,
    zone: str,
    checkpoint: str,
    every: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Run the batch ingest on each micro-batch of newly dropped files.

    ``registry`` is the path of the stored registry, read anew for each batch, so
    a revoked token stops working. Exact: a run is named by the query's id, which
    its checkpoint keeps, and the batch id, so a batch repeated after a failure
    finds its own commit and a query on a new checkpoint meets no old run.
    ``every`` keeps polling, such as ``"300 seconds"``; without it the query ends
    once the directory is read.
    """
    arrivals = (
        spark.readStream.schema(DROP_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(drop_dir)
    )
    query_id: list[str] = []
    named = Event()

    def ingest(batch: DataFrame, batch_id: int) -> None:
        named.wait()
        session = batch.sparkSession
        run_team_ingest(
            session, batch, session.read.parquet(registry), tables, zone, f"{query_id[0]}/{batch_id}"
        )

    writer = arrivals.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    started = writer.trigger(**trigger).start()
    query_id.append(str(started.id))
    named.set()
    return started


def stream_dedupe(events: DataFrame, horizon: str) -> DataFrame:
    """First arrival of each key, forgetting keys older than ``horizon``.

    State stays bounded, so a copy that comes later than the horizon passes;
    ``stream_ingest_envelopes`` is the exact way.
    """
    return events.withWatermark("event_ts", horizon).dropDuplicatesWithinWatermark(
        [*DEVICE, "event_key"]
    )


def latest_only(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of a table fed by update-mode batches, by batch id."""
    newest = F.max_by(F.struct(*updates.columns), "batch_id").alias("_row")
    return updates.groupBy(*keys).agg(newest).select("_row.*").drop("batch_id")
