"""The grading cascade: direct triple, content fact, multi-hop path, else fabricated; and its spurious-path tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.containment import maybe_contained
from ..operators.graph import EDGE, between, degrees, marked, simple_paths, told_steps, with_edges
from ..operators.lineage import cut, stored
from ..operators.linking import claim_ends
from ..operators.scoring import best_premise, holding
from .choices import Choices, best_scored


@dataclass(frozen=True)
class Grounding:
    hops: int = 2
    tau: float = 0.5
    #: A hub has at least so many edges; a path is fragile at a hub up to this margin over tau.
    hub_degree: int = 8
    hub_margin: float = 0.05


def edge_premises(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pid, premise, ord of each edge: subject, property and object in words."""
    named = edges.join(nodes.select(F.col("id").alias("subject_id"), F.col("label").alias("subject_label")), "subject_id", "left")
    text = F.concat_ws(" ", F.coalesce("subject_label", "subject_id"), "property_label", "object_label")
    key = F.concat_ws("|", "subject_id", "property_id", F.coalesce("object_id", F.lit("None")))
    return named.select(key.alias("pid"), text.alias("premise"), F.col("edge_ord").alias("ord"), "subject_id", "object_id", "property_id")


def likely_edges(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges whose premise holds all strings of some set of ``wanted`` (parts, runs of a-z and 0-9), and few others.

    A run lies in the subject's label, the property's or the object's. So a node's label is searched once, however many
    edges the node has, and an edge needs a string in what it says itself, unless its subject's label has a whole set. Edges
    are read once, and only what is left is shuffled.
    """
    least = wanted.agg(F.min(F.size("parts"))).first()[0]
    if least is None:
        return edges.limit(0)
    parts = wanted.select(F.explode("parts").alias("part"))
    told = stored(maybe_contained(nodes.select("id", F.lower("label").alias("low")), "low", parts).select("id", F.col("parts").alias("held")))
    whole = stored(holding(told.where(F.size("held") >= least), wanted, "parts").select("id").distinct())
    # Where the subject's label has none, all strings of a set, also its longest, lie in what the edge says.
    longest = wanted.agg(F.min(F.array_max(F.transform("parts", F.length)))).first()[0]
    said = F.lower(F.concat_ws(" ", "property_label", "object_label"))
    rows = marked(marked(edges, "subject_id", told.select("id"), told.count(), "__told"), "subject_id", whole, whole.count(), "__whole")
    # A subject that is no node is told by its id. An edge of a whole subject is kept by a string put after its text.
    text = F.concat_ws(" ", said, F.lower("subject_id"), F.when(F.col("__whole"), F.lit(parts.first()[0])))
    rows = rows.withColumn("__text", text).where(F.col("__told") | F.col("__text").rlike(f"[a-z0-9]{{{longest}}}"))
    rows = maybe_contained(rows, "__text", parts)
    own = F.exists("parts", lambda p: said.contains(p))
    return stored(rows.where(F.col("__whole") | (F.size("parts") >= least) | (F.col("__told") & own)).select(edges.columns))


def best_triple(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`best_premise` among the premises of edges."""
    told = lambda rows: edge_premises(nodes, rows).select("pid", "premise", "ord")
    return best_premise(claims, told(edges), likely=lambda wanted: told(likely_edges(nodes, edges, wanted)))


def scored_paths(claims: DataFrame, nodes: DataFrame, edges: DataFrame, how: Grounding, by: Choices = Choices()) -> DataFrame:
    """key, nodes, path, mult and score of the simple paths between the entities of a claim: those named in its text and,
    where claims have the columns head and tail, those that these link to."""
    ends = stored(claim_ends(claims, nodes, by.link))
    pairs = ends.join(ends.select("key", F.col("id").alias("dst")), "key").where("id < dst").select("key", F.col("id").alias("src"), "dst")
    pairs = stored(pairs)
    rows = between(edges.select("edge_ord", *EDGE), pairs, how.hops)
    paths = with_edges(simple_paths(pairs, stored(told_steps(rows)), how.hops), rows.select("edge_ord", *EDGE).distinct())
    told = told_paths(stored(paths), nodes, "key", "nodes", "mult", "path")
    return told.join(claims.select("key", "text"), "key").select("key", "nodes", "path", "mult", "premise", by.score(F.col("premise"), F.col("text")).alias("score"))


def told_paths(paths: DataFrame, nodes: DataFrame, *by: str) -> DataFrame:
    """Paths (``by``, path among them) with their premise: told edge by edge, each subject by its label."""
    words = nodes.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    each = paths.select(*by, F.posexplode("path").alias("pos", "e")).join(words, F.col("e.subject_id") == F.col("__id"), "left")
    part = F.concat_ws(" ", F.coalesce("__label", F.col("e.subject_id")), F.col("e.property_label"), F.col("e.object_label"))
    parts = F.sort_array(F.collect_list(F.struct("pos", part.alias("t"))))
    return each.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("premise"))


def route_robustness(paths: DataFrame, how: Grounding = Grounding()) -> DataFrame:
    """Of scored paths (key, nodes, path, score), for each edge of the best accepted path of a claim: key, edge_ord, other
    (the best score of its paths that do without this edge, null if none does), and robust, whether one of these is
    accepted as well. Every path is compared with the edges of its own claim's best one only."""
    best = best_path(paths).where(F.col("score") > how.tau)
    used = cut(best.select("key", F.explode(F.transform("path", lambda e: e["edge_ord"])).alias("edge_ord")).distinct())
    rest = paths.select("key", F.transform("path", lambda e: e["edge_ord"]).alias("own"), "score").join(used, "key").where(~F.array_contains("own", F.col("edge_ord")))
    other = rest.groupBy("key", "edge_ord").agg(F.max("score").alias("other"))
    return used.join(other, ["key", "edge_ord"], "left").select("key", "edge_ord", "other", F.coalesce(F.col("other") > how.tau, F.lit(False)).alias("robust"))


def best_path(paths: DataFrame) -> DataFrame:
    """Per claim the path of best score, the least node path on ties."""
    best = paths.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "nodes", "path", "premise")).alias("b"))
    return best.select("key", F.col("b.nodes").alias("nodes"), F.col("b.path").alias("path"), F.col("b.premise").alias("premise"), (-F.col("b.minus")).alias("score"))


def best_evidence(claims: DataFrame, premises: DataFrame, by: Choices, place: bool = False) -> DataFrame:
    """key, pid and score of the best premise, with ``place`` its ord: by the lexical search or among the candidates."""
    if by.candidates is None:
        return best_premise(claims, premises, place)
    return best_scored(by.candidates(claims.select("key", "text"), premises), by.score, place)


def stages(claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, how: Grounding = Grounding(), by: Choices = Choices()) -> DataFrame:
    """Claims (key, text, and head and tail if known) with the best evidence of each stage and its score: d_id, d_ord and d
    of the triple, c_id and c of the content fact, h_nodes, h_path, h_premise and h of the path. Only claims that no triple
    and no fact supports are searched for paths."""
    nodes, edges = stored(nodes), stored(edges)
    # The result of each search is written, so that no plan holds more than one of them.
    direct = stored(best_evidence(claims, edge_premises(nodes, edges).select("pid", "premise", "ord"), by, place=True))
    content = stored(best_evidence(claims, facts.select(F.col("entity_id").alias("pid"), F.col("fact").alias("premise"), F.col("label_ord").alias("ord")), by))
    stage = stored(claims.join(direct.toDF("key", "d_id", "d", "d_ord"), "key", "left").join(content.toDF("key", "c_id", "c"), "key", "left"))
    open_ = stage.where((F.coalesce("d", F.lit(0.0)) <= how.tau) & (F.coalesce("c", F.lit(0.0)) <= how.tau)).select(*claims.columns)
    hops = stored(best_path(scored_paths(open_, nodes, edges, how, by)).select("key", "nodes", "path", "premise", "score"))
    return stage.join(hops.toDF("key", "h_nodes", "h_path", "h_premise", "h"), "key", "left")


def verdicts(stage: DataFrame, how: Grounding = Grounding()) -> DataFrame:
    """key, status, source, evidence and score of claims with the evidence of each stage. A fabricated claim has the score
    of the triple or fact that came nearest, null if neither scored; paths that aren't accepted don't count."""
    pick = lambda d, c, h, none: F.when(F.col("d") > how.tau, d).when(F.col("c") > how.tau, c).when(F.col("h") > how.tau, h).otherwise(none)
    lit = F.lit
    near = F.greatest(*[F.coalesce(x, lit(0.0)) for x in ("d", "c")])
    return stage.select(
        "key",
        pick(lit("retrieved"), lit("retrieved"), lit("reasoned-supportable"), lit("fabricated")).alias("status"),
        pick(lit("direct_triple"), lit("text_content"), lit("multi_hop_path"), lit("none")).alias("source"),
        pick(F.col("d_id"), F.col("c_id"), F.array_join("h_nodes", ">"), lit("")).alias("evidence"),
        pick(F.col("d"), F.col("c"), F.col("h"), F.nullif(near, lit(0.0))).alias("score"),
    )


def grade(claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, how: Grounding = Grounding(), by: Choices = Choices()) -> DataFrame:
    """key, status, source, evidence and score of each claim (key, text, and head and tail if known), scored and linked as
    ``by`` says. Nulls: a claim without text has no evidence."""
    return verdicts(stages(claims, nodes, edges, facts, how, by), how)


def canonical_property(rows: DataFrame, surface: str, aliases: DataFrame) -> DataFrame:
    """Adds pid, the canonical property of a relation's wording or property id (aliases: surface, pid), null without one;
    the case of letters counts."""
    table = aliases.select(F.col("surface").alias(surface), "pid")
    return rows.join(table, surface, "left")


def canonical_way(rows: DataFrame, inverses: DataFrame) -> DataFrame:
    """Rows of edges walked (subject_id, property_id, object_id, back; subject_label and object_label if known) with forward
    for back. An edge whose property has a declared inverse runs the other way under it: ends, labels and direction swap,
    and the property's label stays."""
    rows = rows.join(F.broadcast(inverses.select(F.col("property").alias("property_id"), "inverse")), "property_id", "left")
    flip = F.col("inverse").isNotNull() & F.col("object_id").isNotNull()
    swap = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    new = {"subject_id": swap("subject_id", "object_id"), "object_id": swap("object_id", "subject_id"), "property_id": swap("property_id", "inverse"), "forward": F.col("back") == flip}
    if "subject_label" in rows.columns:
        new |= {"subject_label": swap("subject_label", "object_label"), "object_label": swap("object_label", "subject_label")}
    return rows.withColumns(new).drop("inverse", "back")


def canonical_edges(paths: DataFrame, nodes: DataFrame, inverses: DataFrame) -> DataFrame:
    """The edges of paths (key, nodes, path) as rows: key, nodes, pos, subject and object with labels, property, forward, the
    way that `canonical_way` tells them."""
    rows = paths.select("key", "nodes", F.posexplode("path").alias("pos", "e")).select("key", "nodes", "pos", "e.*")
    labels = nodes.select(F.col("id").alias("subject_id"), F.col("label").alias("__label"))
    rows = rows.join(labels, "subject_id", "left").withColumn("subject_label", F.coalesce("__label", "subject_id"))
    return canonical_way(rows, inverses).select("key", "nodes", "pos", "subject_id", "subject_label", "property_id", "property_label", "object_id", "object_label", "forward")


def spurious(paths: DataFrame, edges: DataFrame, surfaces: DataFrame, how: Grounding = Grounding(), aliases: DataFrame | None = None) -> DataFrame:
    """Of best paths (key, nodes, path, premise, score) the reason to doubt one, or null. surfaces: key, pid (canonical
    property that the claim's relation names, or null), tail (the claim's object text). With aliases (surface, pid) the
    properties of a path are compared in their canonical form."""
    paths = stored(paths)
    inner = paths.select("key", F.explode(F.slice("nodes", F.lit(2), F.size("nodes") - 2)).alias("id"))
    hubs = inner.join(degrees(edges, stored(inner.select("id").distinct())), "id").where(F.col("degree") >= how.hub_degree).select("key").distinct().withColumn("hub", F.lit(True))
    rows = paths.join(surfaces, "key").join(hubs, "key", "left")
    used = paths.select("key", F.explode(F.transform("path", lambda e: e["property_id"])).alias("property_id"))
    if aliases is not None:
        used = canonical_property(used, "property_id", aliases).select("key", F.coalesce("pid", "property_id").alias("property_id"))
    rows = rows.join(used.groupBy("key").agg(F.collect_set("property_id").alias("pids")), "key")
    reason = (
        F.when(F.col("pid").isNotNull() & ~F.array_contains("pids", F.col("pid")), F.lit("relation_illegitimate"))
        .when(F.size(F.array_except(tokens(F.col("tail")), tokens(F.col("premise")))) > 0, F.lit("value_absent"))
        .when((F.size("path") == how.hops) & F.col("hub") & (F.col("score") - how.tau <= how.hub_margin), F.lit("hub_fragility"))
    )
    return rows.select("key", reason.alias("reason"))
