"""Grading again after an edit, but only the claims that the edit could move.

Edges taken out move a claim only if its evidence holds one of them: its best triple, or its best path. Edges put in move it
only if one of them is as good a triple as its best, or touches an entity that its paths run between; with more than two
hops, where a new edge may lie in the middle, every claim with two entities is looked at. All others keep their evidence, so
the work of a small edit is a few joins with what was stored, and the grading of the claims found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import stored
from ..operators.linking import claim_ends
from .cascade import Grounding, best_evidence, edge_premises, stages
from .choices import Choices


def movable(stage: DataFrame, claims: DataFrame, nodes: DataFrame, removed: DataFrame, added: DataFrame, how: Grounding = Grounding(), by: Choices = Choices()) -> DataFrame:
    """key of the claims that an edit could move. stage: what `stages` gave before; removed and added: edges."""
    gone = removed.select("edge_ord").distinct()
    triple = stage.join(gone.withColumnRenamed("edge_ord", "d_ord"), "d_ord", "left_semi").select("key")
    path = stage.select("key", F.explode(F.transform("h_path", lambda e: e["edge_ord"])).alias("edge_ord")).join(gone, "edge_ord", "left_semi").select("key")
    near = best_evidence(claims, edge_premises(nodes, added).select("pid", "premise", "ord"), by).select("key", "score")
    near = near.join(stage.select("key", "d"), "key").where(F.col("score") >= F.coalesce("d", F.lit(0.0))).select("key")
    ends = stored(claim_ends(claims, nodes, by.link))
    if how.hops > 2:
        beside = ends.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key") if not added.isEmpty() else ends.select("key").where("false")
    else:
        touched = added.select(F.col("subject_id").alias("id")).union(added.select("object_id")).where("id IS NOT NULL").distinct()
        beside = ends.join(touched, "id", "left_semi").select("key")
    # Written each on its own: a union of plans that are dealt by one key may be zipped by parts, whose numbers can change.
    one, two, three, four = map(stored, (triple, path, near, beside))
    return one.union(two).union(three).union(four).distinct()


def regrade(stage: DataFrame, claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, removed: DataFrame, added: DataFrame, how: Grounding = Grounding(), by: Choices = Choices()) -> tuple[DataFrame, DataFrame]:
    """The stages of all claims after an edit, as if all had been graded again against ``edges`` less ``removed`` and with
    ``added``, and the keys of the claims that were graded again. Nodes and facts stay; edge_ord is unique over all."""
    again = stored(movable(stage, claims, nodes, removed, added, how, by))
    now = edges.join(removed.select("edge_ord"), "edge_ord", "left_anti").select(*edges.columns).unionByName(added)
    fresh = stages(claims.join(again, "key", "left_semi").select(*claims.columns), nodes, now, facts, how, by)
    return stage.join(again, "key", "left_anti").select(*fresh.columns).unionByName(fresh), again


