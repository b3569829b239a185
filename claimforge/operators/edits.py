"""Edits and repair: the state that a list of edits leaves, statuses from dependencies, edited snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the property of a date of birth.
BIRTH_DATE = "P569"


def edit_state(edits: DataFrame) -> DataFrame:
    """From ord, op (add|remove), key, scope (gen|both): key, in_gen, in_ver; null where no edit touches that side. The
    last edit of a key on a side wins."""
    last = edits.groupBy("key").agg(
        F.max_by(F.col("op") == "add", "ord").alias("in_gen"),
        F.max(F.when(F.col("scope") == "both", F.struct("ord", (F.col("op") == "add").alias("x")))).alias("v"),
    )
    return last.select("key", "in_gen", F.col("v.x").alias("in_ver"))


def edited_snapshot(base: DataFrame, state: DataFrame) -> DataFrame:
    """key and scope_state (both, ver_only, gen_only) of base keys and added ones; keys on neither side go."""
    joined = base.select("key", F.lit(True).alias("base")).join(state, "key", "full_outer")
    gen, ver = (F.coalesce(c, F.coalesce("base", F.lit(False))) for c in ("in_gen", "in_ver"))
    name = F.when(gen & ver, "both").when(ver, "ver_only").when(gen, "gen_only")
    return joined.select("key", name.alias("scope_state")).where("scope_state IS NOT NULL")


def edit_property(relation: Column) -> Column:
    """The property that an edit's relation means: the date of birth for any that speaks of a date, else the relation."""
    return F.when(F.lower(relation).contains("date"), F.lit(BIRTH_DATE)).otherwise(relation)


def content_state(edits: DataFrame) -> DataFrame:
    """From ord, entity_id, scope (gen|both) of withheld texts: entity_id and state; once both sides lost it, they stay so."""
    return edits.groupBy("entity_id").agg(F.when(F.bool_or(F.col("scope") == "both"), F.lit("both")).otherwise(F.lit("gen")).alias("state"))


def edited_graph(nodes: DataFrame, edges: DataFrame, state: DataFrame, added: DataFrame, content: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, description) and edges (key, subject_id, property_id, property_label, object_id, object_label,
    value_type, scope_state) of an edited graph. state: key, in_gen, in_ver; edges on neither side go. added: key,
    subject_id, relation, value, scope; each becomes a string edge. content: entity_id, state; a text that both sides lost
    is gone. entities: id, label, description; ids that are there already stay as they are."""
    columns = ["key", "subject_id", "property_id", "property_label", "object_id", "object_label", "value_type"]
    kept = edges.join(edited_snapshot(edges, state), "key").select(*columns, "scope_state")
    scope = F.when(F.col("scope") == "both", "both").otherwise("gen_only").alias("scope_state")
    new = added.select("key", "subject_id", F.col("key").alias("property_id"), F.coalesce("relation", F.lit("added")).alias("property_label"), F.lit(None).cast("string").alias("object_id"), F.coalesce("value", F.lit("")).alias("object_label"), F.lit("string").alias("value_type"), scope)
    gone = content.where("state = 'both'").select(F.col("entity_id").alias("id"), F.lit(True).alias("__gone"))
    old = nodes.select("id", "label", "description").join(gone, "id", "left").select("id", "label", F.when(F.col("__gone").isNull(), F.col("description")).alias("description"))
    more = entities.select("id", "label", "description").join(nodes.select("id"), "id", "left_anti")
    return old.unionByName(more), kept.unionByName(new)


def effective_claims(claims: DataFrame, statuses: DataFrame, repairs: DataFrame) -> DataFrame:
    """Claims (claim_id, status, support_source, grounding_path) with the status after edits (claim_id, status). One that
    an added triple grounds (repairs: claim_id, subject_id, subject_label, property_id, property_label, object_label) is
    supported by that triple alone; a repair of a claim that stays fabricated changes nothing."""
    literal = F.concat(F.lit("lit:string:"), F.col("r.object_label"))
    edge = F.struct("r.subject_id", "r.subject_label", "r.property_id", "r.property_label", literal.alias("object_id"), F.col("r.object_label").alias("object_label"), F.lit(True).alias("traversed_forward"))
    path = F.struct(F.array(edge).alias("edges"), F.array(F.col("r.subject_id"), literal).alias("node_ids")).cast(claims.schema["grounding_path"].dataType)
    now = statuses.select("claim_id", F.col("status").alias("__now"))
    fix = repairs.select("claim_id", F.struct(*[c for c in repairs.columns if c != "claim_id"]).alias("r"))
    rows = claims.join(now, "claim_id", "left").join(fix, "claim_id", "left").withColumn("status", F.coalesce("__now", "status"))
    mended = F.col("r").isNotNull() & (F.col("status") == "retrieved")
    rows = rows.withColumns({"grounding_path": F.when(mended, path).otherwise(F.col("grounding_path")), "support_source": F.when(mended, F.lit("direct_triple")).otherwise(F.col("support_source"))})
    return rows.select(*claims.columns)


def removal_claims(claims: DataFrame, dependencies: DataFrame, removed: DataFrame, name: str, prefix: str = "rm-") -> DataFrame:
    """The claims of a run that draws without some triples, to stand beside its baseline's: those that depend
    (claim_id, key) on a removed key are fabricated, without a source, score or path, and note ``name`` as the active
    perturbation. Ids get a prefix, since ids have a meaning in one run only."""
    hit = dependencies.join(removed.select("key"), "key", "left_semi").select("claim_id").distinct().withColumn("__hit", F.lit(True))
    rows = claims.join(hit, "claim_id", "left")
    bare = F.struct(F.array().alias("edges"), F.array().alias("node_ids")).cast(claims.schema["grounding_path"].dataType)
    lost = {"status": F.lit("fabricated"), "support_source": F.lit("none"), "grounding_path": bare, "active_perturbations": F.array(F.lit(name)), "entailment_score": F.lit(None).cast("double")}
    rows = rows.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in lost.items() if c in claims.columns})
    return rows.withColumn("claim_id", F.concat(F.lit(prefix), "claim_id")).select(*claims.columns)


def sampled_claims(outcomes: DataFrame, claims: DataFrame, n: int, most: int = 20) -> DataFrame:
    """slot, claim_id and status of the claims of n draws (1 to ``most``) from outcomes (fact, slot, outcome ok|fab|absent)
    and template claims (fact, status): an absent fact has no claim, one drawn wrongly is fabricated."""
    rows = outcomes.where(F.col("slot") < max(1, min(n, most))).where("outcome <> 'absent'").join(claims.select("fact", "status"), "fact")
    status = F.when(F.col("outcome") == "ok", F.col("status")).otherwise(F.lit("fabricated"))
    return rows.select("slot", F.concat(F.lit("r"), F.col("slot").cast("string"), F.lit("-"), "fact").alias("claim_id"), status.alias("status"))


def dependency_status(claims: DataFrame, snapshot: DataFrame) -> DataFrame:
    """From claim_id, grounded, key (one row a dependency) and the edited snapshot: claim_id and status. Grounded if all
    keys are on both sides, else fabricated: by absence if the verifier still has all, else by a gap."""
    rows = claims.join(snapshot, "key", "left")
    each = rows.groupBy("claim_id", "grounded").agg(
        F.bool_and(F.coalesce(F.col("scope_state").isin("both", "gen_only"), F.lit(False))).alias("gen"),
        F.bool_and(F.coalesce(F.col("scope_state").isin("both", "ver_only"), F.lit(False))).alias("ver"),
    )
    status = F.when(F.col("gen") & F.col("ver"), F.col("grounded")).otherwise(F.lit("fabricated"))
    reason = F.when(F.col("gen") & F.col("ver"), F.lit("none")).when(F.col("ver"), F.lit("absence")).otherwise(F.lit("gap"))
    return each.select("claim_id", status.alias("status"), reason.alias("reason"))


def spread_outcomes(counts: DataFrame) -> DataFrame:
    """From fact, outcome, rank, n: slot (from 0) and outcome of each draw of a fact, spread evenly: copy k of an outcome
    stands at k / n, ties by rank."""
    from pyspark.sql import Window as W

    copies = counts.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    order = W.partitionBy("fact").orderBy(F.col("k") / F.col("n"), "rank")
    return copies.select("fact", (F.row_number().over(order) - 1).alias("slot"), "outcome")


def removed_keys(base: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Base keys that the generation side of an edited snapshot lacks."""
    held = snapshot.where(F.col("scope_state").isin("both", "gen_only")).select("key")
    return base.select("key").join(held, "key", "left_anti")


def repaired_by_edit(paths: DataFrame, added: DataFrame) -> DataFrame:
    """claim_id of claims whose path (claim_id, key: one row an edge) runs over an added triple (key)."""
    return paths.join(added.select("key"), "key", "left_semi").select("claim_id").distinct()
