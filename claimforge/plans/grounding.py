"""From answers to graded runs: claims, links of their heads and tails, grades, and the runs' summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cue_parts, normalize, sentences
from ..operators.lineage import stored
from ..operators.linking import ACCEPT, link_text, side_links, unresolved
from ..operators.runs import status_counts
from .cascade import Grounding, grade
from .choices import Choices, cached_answers, generation_key


def answer_claims(answers: DataFrame) -> DataFrame:
    """From run_id, answer_text: key (run_id, claim_pos), claim_id within the run, text, head, relation, tail."""
    rows = answers.select("run_id", F.posexplode(sentences(F.col("answer_text"))).alias("claim_pos", "text"))
    rows = rows.withColumn("parts", cue_parts(F.col("text")))
    key = F.struct("run_id", "claim_pos").alias("key")
    return rows.select(key, "run_id", F.concat(F.lit("c"), F.col("claim_pos") + 1).alias("claim_id"), "text", "parts.*")


def claim_links(claims: DataFrame, nodes: DataFrame, by: Choices = Choices()) -> DataFrame:
    """key, linked, ids and unresolved of each claim. linked: entities with label, description and link score in the order
    of discovery (head, tail, labels in the text), each once. unresolved: heads and tails without a link, then letter
    tokens that no found label covers."""
    linked = stored(side_links(claims, nodes, by.link))
    about = F.col("description") if "description" in nodes.columns else F.lit(None).cast("string")
    order = nodes.select("id", "node_ord", "label", about.alias("description"))
    near = linked.where(F.col("score") >= ACCEPT).select("key", "id", F.struct(F.col("side").alias("src"), F.lit(0).cast("long").alias("pos")).alias("at"), "score")
    inside = link_text(claims, nodes).join(order, "id").select("key", "id", F.struct(F.lit(2).alias("src"), F.col("node_ord").alias("pos")).alias("at"), F.lit(1.0).alias("score"))
    found = stored(near.unionByName(inside).groupBy("key", "id").agg(F.min(F.struct("at", "score")).alias("first")))
    found = found.join(order.drop("node_ord"), "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "id", "label", "description"))).alias("f"))
    lost = linked.where("id IS NULL").groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("side", "mention"))), lambda x: x["mention"]).alias("lost"))
    none = F.array().cast("array<string>")
    out = claims.select("key", "text").join(found, "key", "left").join(lost, "key", "left")
    out = out.withColumn("f", F.coalesce("f", F.array().cast(found.schema["f"].dataType)))
    covered = F.flatten(F.transform("f", lambda x: F.regexp_extract_all(normalize_label(x["label"]), F.lit("[A-Za-z]+"), F.lit(0))))
    out = out.withColumn("covered", covered)
    return out.select(
        "key",
        F.transform("f", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["description"].alias("description"), x["first"]["score"].alias("link_score"))).alias("linked"),
        F.transform("f", lambda x: x["id"]).alias("ids"),
        F.array_distinct(F.concat(F.coalesce("lost", none), unresolved(F.col("text"), F.col("covered")))).alias("unresolved"),
    )


def normalize_label(label):
    """Lower case; enough for the letter tokens of a label."""
    return F.lower(label)


def ground(answers: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, how: Grounding = Grounding(), by: Choices = Choices()) -> DataFrame:
    """run_id, claim_id, text, status, source, evidence, score, ids, unresolved of each claim of each answer. Paths are
    searched between all entities that a claim is linked with."""
    claims = answer_claims(answers)
    graded = stored(grade(claims.select("key", "text", "head", "tail"), nodes, edges, facts, how, by))
    return claims.join(graded, "key").join(claim_links(claims, nodes, by), "key").drop("key", "linked")


def summaries(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Per run the status counts and the fabrication rate, 0 for a run without claims."""
    counts = runs.select("run_id").join(status_counts(claims, "run_id"), "run_id", "left").na.fill(0)
    return counts.withColumn("fabrication_rate", F.coalesce(F.try_divide("fabricated", "total"), F.lit(0.0)))


def sweep_answers(plan: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sweep plan with its answers (item, condition, sample, answer_text; a rerun without an edit draws from the full
    condition's answers unless it has its own), and the rows that no answer is there for."""
    own = answers.select("item", "condition", "sample", F.col("answer_text").alias("own"))
    full = answers.where("condition = 'full'").select("item", "sample", F.col("answer_text").alias("other"))
    rows = plan.join(own, ["item", "condition", "sample"], "left").join(full, ["item", "sample"], "left")
    text = F.coalesce("own", F.when(F.col("condition") == "full-no-edit-rerun", F.col("other")))
    rows = rows.withColumn("answer_text", text).drop("own", "other")
    return rows.where("answer_text IS NOT NULL"), rows.where("answer_text IS NULL").drop("answer_text")


def answered_sweep(plan: DataFrame, asked: DataFrame, cache: DataFrame, temperature: float) -> tuple[DataFrame, DataFrame]:
    """A sweep plan with the answers that a cache (generation_key, answer_text) holds, and what is still to be drawn: plan
    rows with question, context, generation_key. asked: item, condition, question, context (as text); the key covers all
    that a draw depends on, so an answer is used for no other context, temperature or seed. A rerun without an edit takes
    the full condition's answer where it has none; rows that nothing is asked for can't be drawn and raise."""
    unasked = F.raise_error(F.concat_ws(" ", F.lit("nothing to ask for"), "item", "condition"))
    rows = plan.join(asked.withColumn("__there", F.lit(True)), ["item", "condition"], "left").withColumn("question", F.when(F.col("__there"), F.col("question")).otherwise(unasked)).drop("__there")
    rows = rows.withColumn("generation_key", generation_key(F.col("question"), F.col("context"), F.lit(temperature), F.col("seed")))
    held, _ = cached_answers(rows, cache)
    done, open_ = sweep_answers(plan, held.select("item", "condition", "sample", "answer_text"))
    return done, rows.join(open_.select("run_id"), "run_id", "left_semi")


def slot_difference(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Why a claim (key, subject_id, property_id, object_label) isn't held: ``held`` if the graph has the triple after all,
    ``value`` if it has the subject and property with other objects only, ``missing`` if it has none."""
    slots = edges.groupBy("subject_id", "property_id", "object_label").agg(F.count(F.lit(1)).alias("n"))
    asked = claims.select("key", "subject_id", "property_id", F.col("object_label").alias("wanted"))
    met = asked.join(slots, ["subject_id", "property_id"], "left").groupBy("key").agg(F.count("n").alias("n"), F.coalesce(F.bool_or(F.col("object_label") == F.col("wanted")), F.lit(False)).alias("same"))
    return met.select("key", F.when(F.col("same"), "held").when(F.col("n") > 0, "value").otherwise("missing").alias("reason"))


def borderline(scores: DataFrame, taus: list[float], delta: float = 0.05) -> DataFrame:
    """tau and the number of claims (score) within ``delta`` of it."""
    rows = scores.select(F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    return rows.groupBy("tau").agg(F.count_if(F.abs(F.col("score") - F.col("tau")) < delta).alias("borderline"))


def net_repair_leverage(before: DataFrame, after: DataFrame, rerun: DataFrame) -> DataFrame:
    """One row: claims (item, text, status) fabricated before and grounded after an edit, matched by normalised text in
    an item, less those that flip in a rerun without an edit."""
    key = lambda df, name: df.select("item", normalize(F.col("text")).alias("norm"), (F.col("status") == "fabricated").alias(name)).groupBy("item", "norm").agg(F.bool_or(name).alias(name))
    rows = key(before, "b").join(key(after, "a"), ["item", "norm"], "left").join(key(rerun, "r"), ["item", "norm"], "left").where("b")
    gross, noise = F.count_if(~F.coalesce("a", F.lit(True))), F.count_if(~F.coalesce("r", F.lit(True)))
    return rows.agg(gross.alias("gross"), noise.alias("noise"), (gross - noise).alias("net"))
