"""Snapshot construction: filters over raw rows, nodes by first sighting, edges, overlap and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import stored
from pyspark.sql import Window as W

# The value types of edges, the datatype names that map to them, and the names' aliases in lower case.
VALUE_TYPES = ("item", "time", "quantity", "monolingual", "string")
DATATYPES = {"WikibaseItem": "item", "Time": "time", "Quantity": "quantity", "Monolingualtext": "monolingual", "String": "string"}
ALIASES = {"wikibase-item": "item", "item": "item", "time": "time", "quantity": "quantity", "monolingualtext": "monolingual", "string": "string"}
ONTOLOGY = "http://wikiba.se/ontology#"
URI_PREFIX = r"^http://www\.wikidata\.org/(entity/|prop/direct/|prop/)"


def in_band(count: Column, low: int = 5, high: int = 40) -> Column:
    """Inclusive band; null is outside."""
    return F.coalesce(count.between(low, high), F.lit(False))


def value_type(datatype: Column) -> Column:
    """The value type of a datatype given by its exact name, by that name after the ontology's prefix, or by an alias in
    any case; null if it isn't kept."""
    table = lambda values, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
    uris = {ONTOLOGY + name: kind for name, kind in DATATYPES.items()}
    return F.coalesce(table(DATATYPES | uris, datatype), table(ALIASES, F.lower(datatype)))


def bare_id(uri: Column) -> Column:
    return F.regexp_replace(uri, URI_PREFIX, "")


def literal_id(kind: Column, label: Column) -> Column:
    return F.concat(F.lit("lit:"), kind, F.lit(":"), label)


def checked_value_type(kind: Column) -> Column:
    return F.when(kind.isin(*VALUE_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown value type: "), F.coalesce(kind, F.lit("null")))))


def first_sighting_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of triple rows (subject_*, object_*, row_ord): the first sighting of an id gives all its attributes. In a
    row the subject is seen before the object; an object shows a label only."""
    subjects = rows.select(
        F.col("subject_id").alias("id"), F.col("subject_label").alias("label"), F.col("subject_description").alias("description"),
        F.col("subject_sitelinks").alias("sitelinks"), F.struct(F.col("row_ord").alias("r"), F.lit(0).alias("side")).alias("seen"),
    )
    objects = rows.where("object_id IS NOT NULL").select(
        F.col("object_id").alias("id"), F.col("object_label").alias("label"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("int").alias("sitelinks"), F.struct(F.col("row_ord").alias("r"), F.lit(1).alias("side")).alias("seen"),
    )
    # Rows with one order differ by label, so that ties have one outcome.
    first = subjects.unionByName(objects).groupBy("id").agg(F.min(F.struct("seen", "label", "description", "sitelinks")).alias("f"))
    return first.select("id", "f.label", "f.description", "f.sitelinks")


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges with their rank among the edges of their subject by property, object and label; nothing is merged."""
    order = W.partitionBy("subject_id").orderBy("property_id", F.coalesce("object_id", F.lit("")), "object_label", "edge_ord")
    return edges.withColumn("edge_rank", F.row_number().over(order))


def overlap_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per subject of an edge: number of edges and whether it has a description (not blank)."""
    counts = edges.groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("triples"))
    described = F.coalesce(F.regexp_replace("description", r"(?U)^\s+|\s+$", "") != "", F.lit(False))
    return counts.join(nodes.select("id", described.alias("described")), "id", "left").select("id", "triples", F.coalesce("described", F.lit(False)).alias("described"))


def overlap_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, and how many of them have a description, none, edges, and both. Entities are the subjects of
    edges; without any edge, all nodes."""
    subjects = overlap_report(nodes, edges)
    if edges.isEmpty():
        described = F.coalesce(F.regexp_replace("description", r"(?U)^\s+|\s+$", "") != "", F.lit(False))
        subjects = nodes.groupBy("id").agg(F.bool_or(described).alias("described")).select("id", F.lit(0).cast("long").alias("triples"), "described")
    told, linked = F.col("described"), F.col("triples") > 0
    return subjects.agg(
        F.count(F.lit(1)).alias("num_entities"), F.count_if(told).alias("num_with_description"), F.count_if(~told).alias("num_without_description"),
        F.count_if(linked).alias("num_with_triples"), F.count_if(told & linked).alias("num_with_both"),
    )


def numbered_edges(edges: DataFrame, keep: str = "edge_ord") -> DataFrame:
    """Edges with edge_no, their place from 0 in the order of subject, property, object (null as empty), object label and
    ``keep``; nothing is merged. Range partitions are sorted each on its own, and a partition's count is added to those
    after it, so no task holds more than its part; only a row for each partition meets in one."""
    order = ["subject_id", "property_id", F.coalesce("object_id", F.lit("")), "object_label", keep]
    placed = stored(edges.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()))
    part = F.shiftright("__n", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("__part", (F.sum("k").over(W.orderBy("__part")) - F.col("k")).alias("__before"))
    rows = placed.withColumn("__part", part).join(before, "__part")
    return rows.select(*edges.columns, (F.col("__before") + F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))).alias("edge_no"))


def reference_id(snapshot_id: str, labels: DataFrame) -> DataFrame:
    """One row: ``snapshot_id:`` and 16 hex digits over all content facts, whatever their order. Each fact's sha256 is cut
    into eight numbers, the numbers are summed, and the sums are digested: no task holds more than eight numbers."""
    h = F.sha2(F.concat_ws("\x1f", "entity_id", "modality", "fact", "source"), 256)
    part = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    sums = labels.agg(*[F.coalesce(F.sum(part(k).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"s{k}") for k in range(8)])
    return sums.select(F.concat(F.lit(f"{snapshot_id}:"), F.substring(F.sha2(F.concat_ws(",", *[f"s{k}" for k in range(8)]), 256), 1, 16)).alias("reference_id"))


def text_labels(facts: DataFrame) -> DataFrame:
    """Content labels of text from entity_id, fact, source and label_ord, which keeps the order they were written in."""
    return facts.select("entity_id", F.lit("text").alias("modality"), "fact", "source", "label_ord")
