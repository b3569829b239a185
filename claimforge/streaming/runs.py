"""An extension: status counts kept up to date while runs arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import RUN


def stream_runs(spark: SparkSession, path: str) -> DataFrame:
    """Claims of runs as their files arrive; multi-line JSON documents."""
    runs = spark.readStream.schema(RUN).option("multiLine", True).json(path)
    return runs.where("run_id IS NOT NULL").select("run_id", "condition", F.explode("claims.status").alias("status"))


def stream_status_counts(claims: DataFrame) -> DataFrame:
    """Counts by condition and status, for output mode ``update`` or ``complete``."""
    return claims.groupBy("condition", "status").count()
