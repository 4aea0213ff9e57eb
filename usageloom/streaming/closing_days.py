"""Daily sums over a stream whose days close, and a side table of what came too late.

The watermark is the latest instant of all earlier batches less a horizon. A row
whose local day ended before it is late: it goes whole to the side table and no
sum changes. All other rows are summed per batch and day. A day that the
watermark passes is summed once more, over its batches, and never changes again.

Each batch writes folders of its own number, replaced if the batch is repeated,
so a failed batch leaves no trace. Partial sums of a closed day are removed one
batch after it closed, when no repetition can need them: what the job keeps open
is one row per batch, open day, team and tool, and two instants.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from usageloom.functions.instants import local_date
from usageloom.model import TOKENS
from usageloom.plans.store import existing
from usageloom.session import remove_folder

_KEY = ("local_date", "team_id", "tool")
_SUMS = (*TOKENS, "usage_event_count")
DAY_SCHEMA = T.StructType(
    [
        T.StructField("team_id", T.StringType()),
        T.StructField("tool", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in _SUMS],
        T.StructField("local_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
MARK_SCHEMA = T.StructType(
    [
        T.StructField("seen", T.TimestampType()),
        T.StructField("closed_before", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def day_end(day: Column, zone: str) -> Column:
    """The instant at which a local date is over."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _SUMS])


@dataclass(frozen=True)
class ClosingDays:
    """The tables of one such stream: ``open``, ``closed``, ``late`` and ``marks`` below a folder."""

    root: str
    zone: str
    horizon: str

    def _last_mark(self, spark: SparkSession, batch_id: int):
        marks = existing(spark, f"{self.root}/marks", MARK_SCHEMA)
        return marks.where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()

    def _over(self, bound) -> Column:
        """Whether a row's day ended before a watermark; before any event none did."""
        if bound is None:
            return F.lit(False)
        return F.coalesce(day_end(F.col("local_date"), self.zone) <= F.lit(bound), F.lit(False))

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Add one batch; repeating it, or one that failed half-way, gives the same tables.

        Rows without an instant belong to no day and count as late.
        """
        spark = batch.sparkSession
        before = self._last_mark(spark, batch_id)
        bound = before.closed_before if before else None
        rows = batch.withColumn("local_date", local_date(F.col("event_ts"), self.zone))
        late = F.col("event_ts").isNull() | self._over(bound)
        rows.where(late).write.mode("overwrite").parquet(f"{self.root}/late/batch_id={batch_id}")
        sums = rows.where(~late).groupBy(*_KEY).agg(
            *[F.sum(t).cast("bigint").alias(t) for t in TOKENS], F.count(F.lit(1)).alias("usage_event_count")
        )
        (
            sums.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("local_date", "batch_id")
            .parquet(f"{self.root}/open")
        )
        seen = batch.agg(F.max("event_ts")).first()[0]
        if before and before.seen and (seen is None or before.seen > seen):
            seen = before.seen
        mark = spark.createDataFrame([(seen,)], "seen timestamp").select(
            "seen", (F.col("seen") - F.expr(f"INTERVAL {self.horizon}")).alias("closed_before")
        )
        now = mark.first().closed_before
        partial = self._partials(spark).where((F.col("batch_id") <= batch_id) & ~self._over(bound) & self._over(now))
        _merged(partial).write.mode("overwrite").parquet(f"{self.root}/closed/batch_id={batch_id}")
        # Days closed by an earlier batch are safe in ``closed``.
        done = self._partials(spark).where(self._over(bound)).select("local_date").distinct().collect()
        for day in done:
            remove_folder(spark, f"{self.root}/open/local_date={day.local_date}")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marks/batch_id={batch_id}")

    def _partials(self, spark: SparkSession) -> DataFrame:
        return existing(spark, f"{self.root}/open", DAY_SCHEMA)

    def start(self, events: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Feed a stream of events; without ``every`` the query ends once its source is read."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        writer = events.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start()

    def closed_days(self, spark: SparkSession) -> DataFrame:
        """Sums of the days that have closed; each day comes from one batch."""
        return existing(spark, f"{self.root}/closed", DAY_SCHEMA).drop("batch_id")

    def open_days(self, spark: SparkSession) -> DataFrame:
        """Sums so far of the days that still take rows."""
        last = self._last_mark(spark, 1 << 62)
        return _merged(self._partials(spark).where(~self._over(last.closed_before if last else None)))

    def late_rows(self, spark: SparkSession, events: T.StructType) -> DataFrame:
        """The rows of ``events`` that came after their day had closed, by batch."""
        extra = [T.StructField("local_date", T.DateType()), T.StructField("batch_id", T.LongType())]
        return existing(spark, f"{self.root}/late", T.StructType([*events.fields, *extra]))
