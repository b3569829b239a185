"""Full records of graded claims, with their paths and links, and the runs that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.snapshot import literal_id
from ..sources.store import PATH
from .cascade import Grounding, canonical_edges, canonical_property, spurious, stages, verdicts
from .grounding import answer_claims, claim_links

EDGE = ("subject_id", "property_id", "property_label", "object_id", "object_label")


def evidence_paths(stage: DataFrame, nodes: DataFrame, edges: DataFrame, inverses: DataFrame, how: Grounding = Grounding()) -> DataFrame:
    """key and grounding_path of claims with the evidence of each stage: the triple or the path in canonical orientation
    with the nodes it runs over, a content fact's entity without edges, and neither for a fabricated claim. edge_ord is
    unique among the edges."""
    top = F.when(F.col("d") > how.tau, 0).when(F.col("c") > how.tau, 1).when(F.col("h") > how.tau, 2)
    rows = stage.select("*", top.alias("stage"))
    told = edges.select(F.col("edge_ord").alias("d_ord"), *EDGE, literal_id(F.col("value_type"), F.col("object_label")).alias("literal"))
    one = F.struct(F.lit(False).alias("back"), F.col("d_ord").alias("edge_ord"), *EDGE)
    direct = rows.where("stage = 0").select("key", "d_ord").join(told, "d_ord")
    direct = cut(direct.select("key", F.array("subject_id", F.coalesce("object_id", "literal")).alias("nodes"), F.array(one).alias("path"), (F.col("object_id").isNull()).alias("literal")))
    hops = rows.where("stage = 2").select("key", F.col("h_nodes").alias("nodes"), F.col("h_path").alias("path"))
    each = canonical_edges(direct.select("key", "nodes", "path").unionByName(hops), nodes, inverses)
    edge = F.struct("subject_id", "subject_label", "property_id", "property_label", "object_id", "object_label", F.col("forward").alias("traversed_forward"))
    path = each.groupBy("key", "nodes").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", edge.alias("e")))), lambda x: x["e"]).alias("edges"))
    # The nodes of a triple follow the way it is told; those of a path are in the order of the search.
    turned = path.join(direct.select("key", "literal"), "key", "left")
    first = F.col("edges")[0]
    ids = F.when(F.col("literal") == F.lit(False), F.array(first["subject_id"], first["object_id"])).otherwise(F.col("nodes"))
    found = turned.select("key", F.struct("edges", ids.alias("node_ids")).cast(PATH).alias("p"))
    none = F.array().cast(PATH[len("struct<edges:") : PATH.index(",node_ids")])
    bare = F.struct(none.alias("edges"), F.when(F.col("stage") == 1, F.array("c_id")).otherwise(F.array().cast("array<string>")).alias("node_ids")).cast(PATH)
    return rows.select("key", "stage", "c_id").join(found, "key", "left").select("key", F.coalesce("p", bare).alias("grounding_path"))


def doubts(stage: DataFrame, claims: DataFrame, edges: DataFrame, aliases: DataFrame, how: Grounding = Grounding()) -> DataFrame:
    """key and spurious_reason of the claims (key, relation, tail) that a path supports; null where none applies."""
    taken = stage.where((F.coalesce("d", F.lit(0.0)) <= how.tau) & (F.coalesce("c", F.lit(0.0)) <= how.tau) & (F.col("h") > how.tau))
    paths = taken.select("key", F.col("h_nodes").alias("nodes"), F.col("h_path").alias("path"), F.col("h_premise").alias("premise"), F.col("h").alias("score"))
    surfaces = canonical_property(claims.select("key", "relation", "tail"), "relation", aliases).select("key", "pid", "tail")
    return spurious(paths, edges, surfaces, how, aliases).withColumnRenamed("reason", "spurious_reason")


def claim_records(claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, inverses: DataFrame, aliases: DataFrame, active: tuple[str, ...] = (), how: Grounding = Grounding()) -> DataFrame:
    """Claims (key, text, head, relation, tail) with all that a stored record holds: status, support_source,
    linked_entities, grounding_path, active_perturbations, entailment_score, spurious_path, spurious_reason and
    unresolved_entities. ``active`` is noted with each claim and changes no grade."""
    stage = cut(stages(claims.select("key", "text", "head", "tail"), nodes, edges, facts, how))
    out = claims.join(verdicts(stage, how), "key").join(evidence_paths(stage, nodes, edges, inverses, how), "key")
    out = out.join(doubts(stage, claims, edges, aliases, how), "key", "left").join(claim_links(claims, nodes), "key")
    names = F.array(*map(F.lit, active)).cast("array<string>")
    return out.select(
        *claims.columns, "status", F.col("source").alias("support_source"), F.col("linked").alias("linked_entities"), "grounding_path",
        names.alias("active_perturbations"), F.col("score").alias("entailment_score"), F.col("spurious_reason").isNotNull().alias("spurious_path"),
        "spurious_reason", F.col("unresolved").alias("unresolved_entities"),
    )


def run_records(runs: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, inverses: DataFrame, aliases: DataFrame, reference_id: str, active: tuple[str, ...] = (), how: Grounding = Grounding()) -> DataFrame:
    """Runs (run_id, answer_text and more) with claims in the order of the answer, error_rates (structure: the share of
    fabricated claims, 0 without claims; text and image: 0), active_perturbations and the id of the reference that they are
    graded against."""
    claims = answer_claims(runs)
    full = claim_records(claims, nodes, edges, facts, inverses, aliases, active, how)
    stored = ["claim_id", "text", "status", "support_source", "linked_entities", "grounding_path", "active_perturbations", "entailment_score", "spurious_path", "spurious_reason", "unresolved_entities"]
    rows = full.select(F.col("key.run_id").alias("run_id"), F.col("key.claim_pos").alias("pos"), F.struct(*stored).alias("c"))
    held = rows.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("claims"),
        F.avg((F.col("c.status") == "fabricated").cast("double")).alias("structure"),
    )
    out = runs.join(held, "run_id", "left")
    rates = F.create_map(F.lit("structure"), F.coalesce("structure", F.lit(0.0)), F.lit("text"), F.lit(0.0), F.lit("image"), F.lit(0.0))
    none = F.array().cast(held.schema["claims"].dataType)
    names = F.array(*map(F.lit, active)).cast("array<string>")
    return out.select(*runs.columns, F.coalesce("claims", none).alias("claims"), names.alias("active_perturbations"), F.lit(reference_id).alias("grading_reference_id"), rates.alias("error_rates"))
