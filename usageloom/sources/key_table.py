"""Keys of stored events as a bucketed table that lookups never move.

Rows are dealt into folders by ``slot``, a hash of the columns in ``by``, and
inside a folder into bucket files by all columns of the key. A lookup reads only
the slots of its batch; the batch is shuffled to the buckets and joined bucket by
bucket, so the stored side has no exchange. A key that is hot in ``by`` (one
device with a third of all events) fills one slot, but still all its buckets.

Every bucket file carries a Bloom filter of the event keys. A small batch is
pushed to the scan as a list, and the filter drops files that hold none of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.session import settings, stage

#: Keys that are pushed to the scan as a list; a larger batch is joined.
PUSHED_KEYS = 2_000


@dataclass(frozen=True)
class KeyLayout:
    """Columns of a key, those that choose the slot, and how many files there are."""

    key: tuple[str, ...]
    by: tuple[str, ...] = ()
    slots: int = 1
    buckets: int = 64

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.slots)).cast("int") if self.by else F.lit(0)


def _name(path: str) -> str:
    return f"usage_keys_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_keys(keys: DataFrame, path: str, layout: KeyLayout) -> None:
    """Write distinct keys as a new table; a bucket of a slot is one sorted file."""
    spark = keys.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    (
        keys.select(*layout.key)
        .dropna()
        .distinct()
        .withColumn("slot", layout.slot())
        .repartition(layout.buckets, *layout.key)
        .write.format("parquet")
        .partitionBy("slot")
        .bucketBy(layout.buckets, *layout.key)
        .sortBy("event_key")
        .option("path", path)
        .option("parquet.bloom.filter.enabled#event_key", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .saveAsTable(_name(path))
    )


def read_keys(spark: SparkSession, path: str, layout: KeyLayout) -> DataFrame:
    """The table at a path; a session that did not write it learns its buckets and slots first."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{c} string" for c in layout.key)
        clustered = ", ".join(layout.key)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, slot int) USING parquet PARTITIONED BY (slot)"
            f" CLUSTERED BY ({clustered}) SORTED BY (event_key) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def stored_among(rows: DataFrame, table: DataFrame, layout: KeyLayout, slots: Sequence[int]) -> DataFrame:
    """Keys of the rows that the table holds, from the given slots only."""
    near = table.where(F.col("slot").isin(list(slots)))
    return near.select(*layout.key).join(rows.select(*layout.key), list(layout.key), "left_semi")


def not_in_table(rows: DataFrame, table: DataFrame, layout: KeyLayout) -> DataFrame:
    """The rows whose key the table lacks; a key with a null is never stored.

    The rows are read three times, so a caller stages them. The slots of a batch
    are at most ``layout.slots`` numbers, a pushed list at most ``PUSHED_KEYS``.
    """
    spark = rows.sparkSession
    slots = [r.slot for r in rows.select(layout.slot().alias("slot")).distinct().collect()]
    few = rows.select("event_key").distinct().limit(PUSHED_KEYS + 1).collect()
    if len(few) <= PUSHED_KEYS:
        table = table.where(F.col("event_key").isin([r.event_key for r in few if r.event_key is not None]))
    with settings(spark, {"spark.sql.parquet.pushdown.inFilterThreshold": PUSHED_KEYS}):
        seen = stage(spark, stored_among(rows, table, layout, slots), "seen")
    return rows.join(seen, list(layout.key), "left_anti")
