"""Session settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC; zones are always explicit job parameters."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Session settings for a block; what was set before comes back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_JOB_FOLDER: ContextVar[str | None] = ContextVar("job_folder", default=None)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory under the shared folder named by ``spark.checkpoint.dir``.

    Inside ``job_scratch`` it lies in the job's own folder. A local temporary
    folder is used only where that setting is absent and the master is local, as
    in tests.
    """
    base = _JOB_FOLDER.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the cluster's file system; a missing one is no error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def job_scratch(spark: SparkSession, job: str) -> Iterator[str]:
    """Scratch folders of a block lie in one folder, which goes when the block ends.

    Nothing that leaves the block may read a table staged in it. A driver that
    dies inside leaves the folder behind, named after the job.
    """
    folder = scratch_dir(spark, job)
    before = _JOB_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _JOB_FOLDER.reset(before)
        remove_folder(spark, folder)


def stage(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table once to shared storage and read it back."""
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
