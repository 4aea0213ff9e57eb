"""Positions in an order, without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageloom.session import scratch_dir


def ranked(
    rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Add the one-based position of each row in ``order`` inside ``within``.

    Rows are dealt by ranges of the whole order, so many rows of one instant or
    one group spread over many tasks. The dealt rows are written once; a row's
    position is its place in its range plus the rows of its group in earlier
    ranges. Only those counts, one per range and group, are ever in one task.
    """
    within = list(within)
    along = [*[F.col(c).asc() for c in within], *order]
    path = scratch_dir(rows.sparkSession, "ranked")
    (
        rows.repartitionByRange(*along)
        .sortWithinPartitions(*along)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    more = [T.StructField("_range", T.IntegerType()), T.StructField("_place", T.LongType())]
    dealt = rows.sparkSession.read.schema(T.StructType(rows.schema.fields + more)).parquet(path)
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy(*within, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) + 1 - F.col("_first"))
        .drop("_rows", "_first")
    )
    # A null group is a group as well, so its columns are compared null-safe.
    moved = shifts.select(F.col("_range").alias("_of"), "_shift", *[F.col(c).alias(f"_of_{c}") for c in within])
    same = F.col("_range") == F.col("_of")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return dealt.join(moved, same).select(*rows.columns, (F.col("_shift") + F.col("_place")).alias(name))
