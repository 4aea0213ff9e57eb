"""Tables written once to the shared folder, so that lineage ends there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.session import scratch_dir, settings


class Stage:
    """Staged tables of one job; ``drop`` removes those that are no longer read.

    With ``shuffled`` joins of staged tables are broadcast only where the code
    says so: a job of many short joins otherwise fills the driver, which collects
    and holds every small side.
    """

    def __init__(self, spark: SparkSession, job: str, shuffled: bool = False):
        self.spark = spark
        self.root = scratch_dir(spark, job)
        self.joins = {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1} if shuffled else {}
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back: a lost executor costs no recomputation."""
        path = f"{self.root}/{len(self.kept)}"
        with settings(self.spark, self.joins):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove staged tables through the cluster's file system."""
        self._remove(lambda table: any(table is gone for gone in tables))

    def leave(self, *tables: DataFrame) -> None:
        """Remove all staged tables but those that the result still reads."""
        self._remove(lambda table: not any(table is read for read in tables))

    def _remove(self, chosen: Callable[[DataFrame], bool]) -> None:
        context = self.spark.sparkContext
        for table, path in [x for x in self.kept if x[1] and chosen(x[0])]:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        self.kept = [(t, "" if chosen(t) else path) for t, path in self.kept]


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """All columns of a table as one column `row`, beside working columns: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """The table again, with the named columns added; they replace columns of the same names."""
    own = [f.name for f in rows.schema["row"].dataType.fields if f.name not in columns]
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in own], *columns)


def ordered_ranks(stage: Stage, keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows with their place (from 0) in the order of ``by``.

    Rows are dealt by range and numbered inside their range; only one count per
    range reaches the driver, so its size is the number of partitions.
    """
    dealt = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = stage.keep(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn(
            name, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        )
    )
    starts, total = [], 0
    for part, rows in sorted(map(tuple, numbered.groupBy("_part").count().collect())):
        starts.append((part, total))
        total += rows
    offsets = keys.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_part", "_start")
    )
