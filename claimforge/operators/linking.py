"""Entity linking: exact labels, containment either way, all labels of a text, canonical triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, normalize
from .containment import contained
from .lineage import stored


def label_index(nodes: DataFrame) -> DataFrame:
    """norm and id: of the nodes with one normalised label the first in node order."""
    rows = nodes.select(normalize(F.col("label")).alias("norm"), "id", "node_ord").where("norm <> ''")
    return rows.groupBy("norm").agg(F.min_by("id", F.struct("node_ord", "id")).alias("id"))


def link_exact(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, mention -> key, id of the node whose label equals the mention."""
    return mentions.select("key", normalize(F.col("mention")).alias("norm")).join(label_index(nodes), "norm").select("key", "id")


def contained_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """key, norm x id, label for all pairs in which one contains the other. Labels are looked up in texts, and texts in
    labels, by automata of bounded blocks; labels and texts that are equal travel once."""
    names = labels.select("label").distinct()
    # Each lookup is written by itself: in one plan, dozens of stages run side by side, and the driver holds them all.
    inside = stored(contained(texts.select("key", "norm"), "norm", names.select(F.col("label").alias("part"))).withColumnRenamed("part", "label"))
    around = stored(contained(names, "label", texts.select(F.col("norm").alias("part"))).withColumnRenamed("part", "norm"))
    pairs = inside.join(labels, "label").select("key", "norm", "id", "label")
    return pairs.union(around.join(labels, "label").join(texts, "norm").select("key", "norm", "id", "label")).distinct()


def link_best(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, id, score: the exact node (score 1), else the contained or containing label of best score, least id on ties.
    A label scores its length over the longer of label and mention."""
    # Both are read several times, and what normalising them takes is done once.
    texts = stored(mentions.select("key", normalize(F.col("mention")).alias("norm")).where("norm <> ''"))
    index = stored(label_index(nodes))
    exact = texts.join(index, "norm").select("key", "id", F.lit(1.0).alias("score"))
    open_ = texts.join(exact.select("key"), "key", "left_anti")
    pairs = contained_pairs(open_, index.select("id", F.col("norm").alias("label")))
    score = F.length("label") / F.greatest(F.length("label"), F.length("norm"))
    best = pairs.groupBy("key").agg(F.min(F.struct((-score).alias("minus"), "id")).alias("b"))
    return exact.unionByName(best.select("key", F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score")))


def link_text(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, id for every node (labels aren't merged) whose label contains the text or is contained in it."""
    norm = stored(texts.select("key", normalize(F.col("text")).alias("norm")).where("norm <> ''"))
    labels = stored(nodes.select("id", normalize(F.col("label")).alias("label")).where("label <> ''"))
    return contained_pairs(norm, labels).select("key", "id")


#: Least score at which the link of a head or tail is accepted.
ACCEPT = 0.5


def side_links(claims: DataFrame, nodes: DataFrame, link: Callable[[DataFrame, DataFrame], DataFrame] = link_best) -> DataFrame:
    """key, side (0 head, 1 tail), mention, and the id and score of its best link, null without one. ``link`` turns mentions
    (key, mention) and nodes into key, id and score."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("m")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("m"))))
    mentions = claims.select("key", sides.alias("x")).where("x.m <> ''").select(F.struct("key", "x.side").alias("key"), F.col("x.m").alias("mention"))
    return mentions.join(link(mentions, nodes), "key", "left").select("key.key", "key.side", "mention", "id", "score")


def claim_ends(claims: DataFrame, nodes: DataFrame, link: Callable[[DataFrame, DataFrame], DataFrame] = link_best) -> DataFrame:
    """key, id: the entities of a claim, from the accepted links of its head and tail, where claims have these columns,
    and from the labels in its text."""
    found = link_text(claims, nodes)
    if "head" in claims.columns:
        found = found.union(side_links(claims, nodes, link).where(F.col("score") >= ACCEPT).select("key", "id"))
    return found.distinct()


def unresolved(text: Column, covered: Column) -> Column:
    """Sorted distinct letter tokens of a text that aren't covered by matched labels and aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(normalize(text), F.lit("[A-Za-z]+"), F.lit(0)))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_sort(F.array_except(F.array_except(found, covered), stops))


def canonical_triples(edges: DataFrame, inverses: DataFrame) -> DataFrame:
    """Edges whose property has a declared inverse (property, inverse) run the other way under it; literals stay."""
    joined = edges.join(inverses, edges.property_id == inverses.property, "left")
    flip = F.col("inverse").isNotNull() & F.col("object_id").isNotNull()
    return joined.select(
        "edge_ord",
        F.when(flip, F.col("object_id")).otherwise(F.col("subject_id")).alias("subject_id"),
        F.when(flip, F.col("inverse")).otherwise(F.col("property_id")).alias("property_id"),
        F.when(flip, F.col("subject_id")).otherwise(F.col("object_id")).alias("object_id"),
        flip.alias("flipped"),
    )
