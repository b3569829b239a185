"""Cuts the lineage of tables that a plan reads several times."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a local session takes a temporary folder, and a cluster's,
    whose driver and executors share none, raises ValueError."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or "file:///tmp/claimforge-checkpoints"
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows of a small table, checkpointed in the shared folder; Spark removes them with the DataFrame where
    spark.cleaner.referenceTracking.cleanCheckpoints says so."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """Asks Spark to drop the shuffle files of an action run inside, once it has ended: nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(rows: DataFrame) -> DataFrame:
    """The rows of a large table, written as Parquet to the shared folder, so that later scans read the columns they need.
    Files stand under claimforge/<application id> until the application's owner removes that folder."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/claimforge/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex[:12]}"
    with _cleaning(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
