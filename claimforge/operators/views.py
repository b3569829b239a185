"""Projections for display: graph elements, support of claims, labels, style scales, answer spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import with_targets


def mapped(key: Column, table: dict[str, str], fallback: Column | None = None) -> Column:
    """A value of a table by key; without one the fallback, else the key itself."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), key if fallback is None else fallback)


def elements(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node elements (id, label) and edge elements (id ``s-p-o``, source, target, label), each id once."""
    targets = with_targets(edges)
    own = nodes.select("id", "label", F.lit(0).alias("rank"))
    far = targets.select(F.col("dst").alias("id"), F.col("object_label").alias("label"), F.lit(1).alias("rank"))
    n = own.unionByName(far).groupBy("id").agg(F.min(F.struct("rank", "label")).alias("x")).select("id", "x.label")
    ids = F.concat_ws("-", "subject_id", "property_id", "dst")
    e = targets.select(ids.alias("id"), F.col("subject_id").alias("source"), F.col("dst").alias("target"), F.col("property_label").alias("label"))
    return n, e.groupBy("id").agg(F.min(F.struct("source", "target", "label")).alias("x")).select("id", "x.*")


def support(claims: DataFrame) -> DataFrame:
    """Per claim (linked_entities, grounding_path): edge_ids, node_ids and the anchor (the first linked entity). A claim
    without a path is supported by its anchor alone."""
    edge_ids = F.transform("grounding_path.edges", lambda e: F.concat_ws("-", e["subject_id"], e["property_id"], F.coalesce(e["object_id"], F.concat(F.lit("lit:string:"), e["object_label"]))))
    anchor = F.get("linked_entities", F.lit(0))["id"]
    nodes = F.when(F.size("grounding_path.node_ids") > 0, F.col("grounding_path.node_ids")).when(anchor.isNotNull(), F.array(anchor)).otherwise(F.array().cast("array<string>"))
    return claims.select("run_id", "claim_id", edge_ids.alias("edge_ids"), nodes.alias("node_ids"), anchor.alias("anchor"))


def support_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All entities and edges that a run's claims name, each once; a linked entity's own label comes before a label that
    an edge tells, and that before the id itself."""
    linked = claims.select("run_id", F.explode("linked_entities").alias("x")).select("run_id", "x.id", F.struct(F.lit(0).alias("rank"), F.col("x.label").alias("label")).alias("l"))
    edges = claims.select("run_id", F.explode("grounding_path.edges").alias("e")).select("run_id", "e.*")
    heads = edges.select("run_id", F.col("subject_id").alias("id"), F.struct(F.lit(1).alias("rank"), F.col("subject_label").alias("label")).alias("l"))
    tails = edges.where("object_id IS NOT NULL").select("run_id", F.col("object_id").alias("id"), F.struct(F.lit(1).alias("rank"), F.col("object_label").alias("label")).alias("l"))
    bare = claims.select("run_id", F.explode("grounding_path.node_ids").alias("id")).select("run_id", "id", F.struct(F.lit(2).alias("rank"), F.col("id").alias("label")).alias("l"))
    nodes = linked.unionByName(heads).unionByName(tails).unionByName(bare).where("l.label IS NOT NULL").groupBy("run_id", "id").agg(F.min("l").alias("l")).select("run_id", "id", "l.label")
    kind = F.when(F.col("object_id").isNull(), "string").otherwise("item")
    first = edges.withColumn("value_type", kind).groupBy("run_id", "subject_id", "property_id", "object_id", "value_type").agg(F.min(F.struct("property_label", "object_label")).alias("x"))
    return nodes, first.select("run_id", "subject_id", "property_id", "x.property_label", "object_id", "x.object_label", "value_type")


def highlight(supports: DataFrame, chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """What to mark for chosen claims (badge, claim_id): rows of kind (edge, node, anchor), id, status and label. An edge or
    node takes the status of the last claim chosen that it supports; an anchor shows the badges of all its claims after its
    label (labels: id, label), else after its id. supports: claim_id, status, edge_ids, node_ids, anchor."""
    rows = chosen.join(supports, "claim_id")
    ids = lambda kind, column: rows.select(F.lit(kind).alias("kind"), F.explode(column).alias("id"), "badge", "status")
    marked = ids("edge", "edge_ids").unionAll(ids("node", "node_ids")).groupBy("kind", "id").agg(F.max_by("status", "badge").alias("status"))
    badges = rows.where("anchor IS NOT NULL").groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list("badge")).alias("b"))
    shown = badges.join(labels.select("id", "label"), "id", "left")
    told = F.concat(F.coalesce("label", "id"), F.lit("  ["), F.array_join(F.col("b").cast("array<string>"), ","), F.lit("]"))
    anchors = shown.select(F.lit("anchor").alias("kind"), "id", F.lit(None).cast("string").alias("status"), told.alias("label"))
    return marked.withColumn("label", F.lit(None).cast("string")).unionByName(anchors)


def marked_items(items: DataFrame) -> DataFrame:
    """kind and element id of chosen items (item): a triple ``s|p|o`` is the edge ``s-p-o``, anything else a node."""
    edge = F.col("item").contains("|")
    return items.select(F.when(edge, "edge").otherwise("node").alias("kind"), F.when(edge, F.translate("item", "|", "-")).otherwise(F.col("item")).alias("id"))


def item_label(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items (item: a node id or ``s|p|o``) with a label: each part by its own label (id, label), or as it is."""
    parts = items.select("item", F.posexplode(F.split("item", r"\|")).alias("pos", "id")).join(labels.select("id", "label"), "id", "left")
    told = parts.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("label", "id").alias("t")))).alias("p"))
    return told.select("item", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("label"))


def scaled_style(frequency: Column) -> Column:
    """struct(node_size, node_opacity, edge_width, edge_opacity) of a support frequency."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), frequency))
    return F.struct((40 + 56 * f).alias("node_size"), (0.45 + 0.55 * f).alias("node_opacity"), (1.5 + 7 * f).alias("edge_width"), (0.35 + 0.6 * f).alias("edge_opacity"))


def spans(answer: Column, wanted: Column) -> Column:
    """Of texts (array of struct(id, text)) the first places in an answer, left to right, without overlaps:
    array<struct(start, end, id)>."""
    placed = F.transform(wanted, lambda w: F.struct((F.position(w["text"], answer) - 1).alias("start"), (F.position(w["text"], answer) - 1 + F.length(w["text"])).alias("end"), w["id"].alias("id")))
    found = F.array_sort(F.filter(placed, lambda p: (p["start"] >= 0) & (p["end"] > p["start"])))
    keep = lambda acc, p: F.when(p["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(p))).otherwise(acc)
    return F.aggregate(found, F.array().cast("array<struct<start:int,end:int,id:string>>"), keep)


def with_status(claims: DataFrame, wanted: list[str]) -> DataFrame:
    """Claims of the statuses asked for; none asked for means all."""
    return claims.where(F.col("status").isin(wanted)) if wanted else claims
