"""Exact deduplication by a stateful stream over document files.

A stream reads the files and keeps state by the digest of each text, in RocksDB on the executors' disks and, after each
micro-batch, in the checkpoint folder; there is no watermark, so nothing expires. The state of a digest is the stable
identifier and the content locator (file and row) of the row that stays, and the number of rows seen. Counts and minima
are combined before the shuffle, so a digest that a third of all rows have sends one row a task to its state. A stream
that is started again on its folder reads new files only and goes on with the state of the earlier ones.

A digest is no proof: each row whose digest was hit is compared with the whole text of the row that its state points to.
Rows that differ from it are grouped by their texts. DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has become one space; of equal texts the row of
the least doc_id stays (null ids last; ties by file and row).

Cases: null counts as empty text; leading white space is one space and counts. Very long texts are one row's work. Repeated
rows, and rows of one doc_id, are rows of their own: one stays. A row with a null doc_id stays only if its text has no row
with an id, and its keep_id is null then. An empty table, and a folder without files, give no rows. Other columns of the
documents aren't read by `exact_duplicates`; `without_copies` returns them as they are, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, hidden, scratch_path, small_batches


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class ExactDedup:
    #: Files of a micro-batch.
    batch_files: int = 100_000
    digest: Callable[[Column], Column] = sha256


_STATE = "spark.sql.streaming.stateStore."
_STORE = {
    f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A store is closed once its task has committed: each open one holds some MB of disk and memory, however small.
    f"{_STATE}unloadOnCommit": "true",
    f"{_STATE}rocksdb.boundedMemoryUsage": "true", f"{_STATE}rocksdb.maxMemoryUsageMB": "256",
}
_LOCATOR = "struct<no:boolean,doc_id:bigint,path:string,row:bigint>"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def _located(docs: DataFrame, how: ExactDedup) -> DataFrame:
    """text (normal), digest, and at: the identifier and locator of each row of a file source."""
    at = F.struct(
        F.col("doc_id").isNull().alias("no"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"),
    )
    rows = docs.select(normal_text(F.col("text")).alias("text"), at.alias("at"))
    return rows.withColumn("digest", how.digest(F.col("text")))


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def document_stream(spark: SparkSession, path: str, how: ExactDedup = ExactDedup()) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file."""
    at, store = _hadoop(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", how.batch_files)
    if store.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def run_to_end(docs: DataFrame, folder: str, how: ExactDedup = ExactDedup()) -> None:
    """Takes all files that are there now into the state under ``folder``."""
    seen = _located(docs, how).groupBy("digest").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    with _settings(docs.sparkSession, _STORE):
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


def held_state(spark: SparkSession, folder: str) -> DataFrame:
    """digest, keep (identifier and locator of the row that stays) and n (rows seen) from the state under ``folder``."""
    at, store = _hadoop(spark, f"{folder}/state")
    if not store.exists(at):
        return spark.createDataFrame([], f"digest string, keep {_LOCATOR}, n long")
    state = spark.read.format("statestore").load(folder)
    return state.select("key.digest", F.col("value.min").cast(_LOCATOR).alias("keep"), F.col("value.count").alias("n"))


def exact_duplicates(spark: SparkSession, path: str, folder: str | None = None, how: ExactDedup = ExactDedup()) -> DataFrame:
    """at (identifier and locator), digest, keep (those of the row that stays) and n (rows of this text) of each document.

    ``folder`` holds the stream's state; without it, a new one. Files must stay readable, since state points to them.
    """
    small_batches(spark)
    folder = folder or scratch_path(spark, "exact-dedup-state")
    run_to_end(document_stream(spark, path, how), folder, how)
    scratch = Scratch(spark, "exact-dedup")
    # Written first: a join of two plain exchanges is one that Spark can split where a digest is hot.
    hit = scratch.write("hit", held_state(spark, folder).where("n > 1"))
    rows = _located(spark.read.parquet(path), how)
    told = rows.join(hit.hint("shuffle_hash"), "digest", "left").select("at", "digest", "keep", "n", F.when(F.col("n") > 1, F.col("text")).alias("text"))
    told = scratch.write("told", told)
    lone = told.where("n IS NULL").select("at", "digest", F.col("at").alias("keep"), F.lit(1).cast("long").alias("n"))

    hits = told.where("n > 1")
    kept = scratch.write("kept", hits.where("at.path = keep.path AND at.row = keep.row").select("digest", F.col("text").alias("kept_text")))
    same = F.col("text") == F.col("kept_text")
    checked = hits.join(kept.hint("shuffle_hash"), "digest").select("at", "digest", "keep", "n", F.when(~same, F.col("text")).alias("other"))
    checked = scratch.write("checked", checked)
    scratch.drop("kept", "hit")
    differ = checked.where("other IS NOT NULL")
    return lone.union(checked.select("at", "digest", "keep", "n") if differ.isEmpty() else _collided(checked, differ))


def _collided(checked: DataFrame, differ: DataFrame) -> DataFrame:
    """Decisions where rows of one digest have several texts."""
    others = differ.groupBy("digest", "other").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    apart = differ.select("at", "digest", "other").join(others, ["digest", "other"]).select("at", "digest", "keep", "n")
    equal = checked.where("other IS NULL")
    fewer = equal.join(others.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
    equal = equal.join(fewer, "digest", "left").select("at", "digest", "keep", F.coalesce("fewer", "n").alias("n"))
    return equal.union(apart)


def without_copies(spark: SparkSession, path: str, folder: str | None = None, how: ExactDedup = ExactDedup()) -> DataFrame:
    """The documents that stay, with their own columns."""
    stay = exact_duplicates(spark, path, folder, how).where("at.path = keep.path AND at.row = keep.row").select("at.path", "at.row")
    docs, own = hidden(spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row")))
    at = docs.columns[-2:]
    return docs.join(stay.toDF(*at), at, "left_semi").select(*own[:-2])


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select(
        F.col("at.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("at.path") == F.col("keep.path")) & (F.col("at.row") == F.col("keep.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


OP12_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h, row_number() OVER () AS r FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, r) = 1 AS kept, h AS text_sha256
FROM t"""
