"""Ablation manifests: ordered entries that withhold triples, texts or images, with stable ids.

Entries are rows of ord, type_name, entity_id (null for withheld triples) and triples (array of subject_id, property_id,
object_id; a null object stands for any; null for the other types). Ids of entities and properties are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "array<struct<subject_id:string,property_id:string,object_id:string>>"
DOCUMENT = f"base_slice_id string, perturbations array<struct<type_name:string,id:string,entity_id:string,triples:{TRIPLES}>>"


def _quoted(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"])', r"\\$1"), F.lit('"')))


def triples_json(triples: Column) -> Column:
    """Triples as JSON in the order they are in, keys in order, one space after commas and colons."""
    told = F.transform(triples, lambda t: F.concat(F.lit('{"object_id": '), _quoted(t["object_id"]), F.lit(', "property_id": '), _quoted(t["property_id"]), F.lit(', "subject_id": '), _quoted(t["subject_id"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(told, ", "), F.lit("]"))


def knowledge_id(triples: Column) -> Column:
    """``knowledge_absence:`` and 16 hex digits of the sha256 of the sorted triples' JSON."""
    ranked = F.array_sort(F.transform(triples, lambda t: F.struct(t["subject_id"], t["property_id"], F.coalesce(t["object_id"], F.lit("")), t.alias("t"))))
    return F.concat(F.lit("knowledge_absence:"), F.substring(F.sha2(triples_json(F.transform(ranked, lambda x: x["t"])), 256), 1, 16))


def with_ids(entries: DataFrame) -> DataFrame:
    """Adds the id of each entry."""
    other = F.concat("type_name", F.lit(":"), "entity_id")
    return entries.withColumn("id", F.when(F.col("type_name") == "knowledge_absence", knowledge_id(F.col("triples"))).otherwise(other))


def touched(entries: DataFrame) -> DataFrame:
    """ord, id, entity of the entities that an entry touches: its own, or the subjects of its triples."""
    own = F.when(F.col("entity_id").isNotNull(), F.array("entity_id")).otherwise(F.transform("triples", lambda t: t["subject_id"]))
    return with_ids(entries).select("ord", "id", F.explode(F.array_distinct(own)).alias("entity"))


def entries_touching(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and ids, in manifest order, of the entries that touch one of the key's entities (wanted: key, entity)."""
    met = touched(entries).join(wanted, "entity").select("key", "ord", "id").distinct()
    return met.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))


def to_json(base_slice_id: str, entries: DataFrame) -> DataFrame:
    """One row: the manifest as one JSON document, the same text for the same entries."""
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    named = with_ids(entries)
    rest = [field("id", _quoted(F.col("id"))), field("triples", triples_json(F.col("triples"))), field("type_name", _quoted(F.col("type_name")))]
    own = F.concat_ws(", ", F.when(F.col("entity_id").isNotNull(), field("entity_id", _quoted(F.col("entity_id")))), *rest)
    rows = named.select("ord", F.concat(F.lit("{"), own, F.lit("}")).alias("t"))
    told = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), ", ").alias("t"))
    head = F.concat(F.lit('{"base_slice_id": '), _quoted(F.lit(base_slice_id)), F.lit(', "perturbations": ['))
    return told.select(F.concat(head, "t", F.lit("]}")).alias("json"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest document."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return doc.select(F.posexplode("perturbations").alias("ord", "p")).select("ord", "p.type_name", "p.entity_id", "p.triples")
