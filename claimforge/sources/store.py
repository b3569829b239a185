"""Reading and writing: SPARQL results, snapshots, content facts, runs, gold sets, canons and manifests, as JSON or Parquet.

Schemas are given, never inferred; lists that have an order carry it as a column.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINDINGS = "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
NODE = "id string, label string, description string, sitelinks int, image_path string, kind string"
EDGE = "subject_id string, property_id string, property_label string, object_id string, object_label string, value_type string"
SNAPSHOT = f"snapshot_id string, slice string, domain_qid string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>, meta map<string,string>"
FACT = "entity_id string, modality string, fact string, source string"
PATH = "struct<edges:array<struct<subject_id:string,subject_label:string,property_id:string,property_label:string,object_id:string,object_label:string,traversed_forward:boolean>>,node_ids:array<string>>"
CLAIM = f"claim_id:string,text:string,status:string,support_source:string,linked_entities:array<struct<id:string,label:string,description:string,link_score:double>>,grounding_path:{PATH},active_perturbations:array<string>,entailment_score:double,spurious_path:boolean,spurious_reason:string,unresolved_entities:array<string>"
RUN = f"run_id string, question string, answer_text string, slice string, phase string, condition string, sample_index int, baseline_run_id string, claims array<struct<{CLAIM}>>, active_perturbations array<string>, grading_reference_id string, error_rates map<string,double>"
GOLD = "set_id string, slice_id string, items array<struct<item_id:string,question:string,entity_id:string,expected_outcomes:array<struct<claim_text:string,expected_status:string,modality:string>>,adversarial_negative:boolean,fold:string>>"
CANON = "relation_aliases map<string,string>, inverse_pairs array<struct<property:string,inverse:string>>"


def read_bindings(spark: SparkSession, path: str, first: str) -> DataFrame:
    """Rows of SPARQL JSON results as maps, with their position; sorted by the value of variable ``first``, stably."""
    rows = spark.read.schema(BINDINGS).json(path, multiLine=True).select(F.posexplode("results.bindings").alias("pos", "b"))
    flat = rows.select("pos", F.transform_values("b", lambda k, v: v["value"]).alias("row"))
    return flat.orderBy(F.coalesce(F.try_element_at("row", F.lit(first)), F.lit("")), "pos")


def cache_key(endpoint: str, query: str) -> str:
    return hashlib.sha256(f"{endpoint}\n{query}".encode()).hexdigest()


def fetch_with_retry(fetch: Callable[[str], str], query: str, tries: int = 3, wait: float = 1.0, sleep: Callable = time.sleep) -> str:
    """Calls ``fetch`` again after errors of transport and statuses that pass (429 and 5xx of a gateway), waiting twice as
    long each time; other errors are raised at once. ``fetch`` is the caller's: this module opens no connection."""
    for k in range(tries):
        try:
            return fetch(query)
        except OSError as e:
            if getattr(e, "code", 503) not in (429, 500, 502, 503, 504) or k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("tries must be positive")


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def read_snapshot_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes with node_ord and edges with edge_ord from one JSON document."""
    doc = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("node_ord", "n")).select("n.*", "node_ord")
    edges = doc.select(F.posexplode("edges").alias("edge_ord", "e")).select("e.*", "edge_ord")
    return nodes, edges


def read_facts_json(spark: SparkSession, path: str) -> DataFrame:
    """Content facts of a JSON array with label_ord."""
    raw = spark.read.text(path, wholetext=True)
    struct = FACT.replace(" string", ":string")
    return raw.select(F.posexplode(F.from_json("value", f"array<struct<{struct}>>")).alias("label_ord", "x")).select("x.*", "label_ord")


def write_runs(runs: DataFrame, folder: str) -> None:
    runs.write.mode("overwrite").partitionBy("condition").json(folder)


def read_runs(spark: SparkSession, path: str, slice_name: str | None = None, primary: str | None = None) -> DataFrame:
    """Runs of JSON files (one document each); malformed files are skipped. In order of file name, ``primary`` first."""
    rows = spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path, multiLine=True).where("run_id IS NOT NULL")
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    if slice_name is not None:
        rows = rows.where(F.col("slice") == slice_name)
    return rows.orderBy((F.col("run_id") != F.lit(primary)) if primary else F.lit(0), "file_name")


def run_claims(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "condition", F.posexplode("claims").alias("claim_pos", "c")).select("run_id", "condition", "claim_pos", "c.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row for each expected outcome of a gold set."""
    items = spark.read.schema(GOLD).json(path, multiLine=True).select(F.explode("items").alias("i"))
    return items.select("i.item_id", "i.question", "i.entity_id", "i.adversarial_negative", "i.fold", F.explode("i.expected_outcomes").alias("o")).select("*", "o.*").drop("o")


#: One document of a question bank.
BANK = "bank_id string, slice_id string, schema_version string, items array<struct<item_id:string,question:string,tier:string,entity_id:string,slice_id:string,fact_type:string,out_of_slice_expected:boolean,notes:string>>"


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """bank_id and one row for each item of a question bank."""
    doc = spark.read.schema(BANK).json(path, multiLine=True)
    return doc.select("bank_id", F.explode("items").alias("i")).select("bank_id", "i.*")


def canonical_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """value: each row as JSON with its keys in order and nulls kept, in range partitions that are sorted by ``order``. The
    same rows give the same lines, in the same order over all parts."""
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return held.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def freeze_json(nodes: DataFrame, edges: DataFrame, facts: DataFrame, folder: str) -> None:
    """A snapshot and its content facts as sorted JSON lines, in parts whose names are in their order."""
    for name, rows, order in (("nodes", nodes, ["id"]), ("edges", edges, ["subject_id", "property_id", "object_id", "object_label", "edge_ord"]), ("content_labels", facts, ["label_ord", "entity_id", "fact"])):
        canonical_lines(rows, order).write.mode("overwrite").text(f"{folder}/{name}")


def thaw_json(spark: SparkSession, folder: str, nodes: str, edges: str, facts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and facts of `freeze_json`, with the given schemas."""
    return tuple(spark.read.schema(kind).json(f"{folder}/{name}") for name, kind in (("nodes", nodes), ("edges", edges), ("content_labels", facts)))


def read_canon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """aliases (surface, pid) and inverses (property, inverse)."""
    doc = spark.read.schema(CANON).json(path, multiLine=True)
    return doc.select(F.explode("relation_aliases").alias("surface", "pid")), doc.select(F.explode("inverse_pairs").alias("p")).select("p.*")
