"""Calibration of the cascade on gold claims: stage scores once, every threshold from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.calibration import modality_error, reliability_curve
from ..operators.lineage import stored
from ..operators.linking import link_text
from ..operators.scoring import best_premise
from .cascade import Grounding, best_path, edge_premises, scored_paths


def stage_scores(claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, how: Grounding, paths: DataFrame | None = None) -> DataFrame:
    """key, direct, content, hops (best scores, 0 without evidence) and gated (whether a label is in the text)."""
    # The result of each search is written, so that no plan holds more than one of them.
    direct = stored(best_premise(claims, edge_premises(nodes, edges).select("pid", "premise", "ord")).select("key", F.col("score").alias("direct")))
    content = stored(best_premise(claims, facts.select(F.col("entity_id").alias("pid"), F.col("fact").alias("premise"), F.col("label_ord").alias("ord"))).select("key", F.col("score").alias("content")))
    hops = stored(best_path(scored_paths(claims, nodes, edges, how) if paths is None else paths).select("key", F.col("score").alias("hops")))
    gated = stored(link_text(claims, nodes).select("key").distinct()).withColumn("gated", F.lit(True))
    out = claims.select("key").join(direct, "key", "left").join(content, "key", "left").join(hops, "key", "left").join(gated, "key", "left")
    return out.select("key", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("direct", "content", "hops")], F.coalesce("gated", F.lit(False)).alias("gated"))


def produced(tau: Column) -> Column:
    """The status that stage scores give at a threshold."""
    return F.when((F.col("direct") > tau) | (F.col("content") > tau), "retrieved").when(F.col("hops") > tau, "reasoned-supportable").otherwise("fabricated")


def evidence_score(tau: Column) -> Column:
    """The score that a claim is graded with; of a fabricated one that of the nearest triple or fact."""
    near = F.greatest("direct", "content")
    return F.when(F.col("direct") > tau, F.col("direct")).when(F.col("content") > tau, F.col("content")).when(F.col("hops") > tau, F.col("hops")).otherwise(near)


def judged(gold: DataFrame, scores: DataFrame, tau: float) -> DataFrame:
    """Gold rows (key, expected, modality, adversarial, fold) with produced, correct, margin and gated at tau."""
    t = F.lit(tau)
    rows = gold.join(scores, "key")
    rows = rows.withColumns({"produced": produced(t), "margin": F.abs(evidence_score(t) - t)})
    return rows.withColumn("correct", F.col("produced") == F.col("expected"))


def choose_tau(gold: DataFrame, scores: DataFrame, taus: list[float]) -> float | None:
    """Of the candidates the one with most correct claims of the calibration fold, the least on ties."""
    rows = gold.where("fold = 'calibration'").join(scores, "key").withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    hits = rows.groupBy("tau").agg(F.count_if(produced(F.col("tau")) == F.col("expected")).alias("hits"))
    best = hits.agg(F.min(F.struct((-F.col("hits")).alias("minus"), "tau")).alias("b")).first().b
    return None if best is None else best.tau


def mean_multiplicity(gold: DataFrame, paths: DataFrame, tau: float) -> DataFrame:
    """One row: how many distinct paths (key, nodes, score) above tau a claim expected to be supportable has, in the mean;
    0 without such claims."""
    taken = paths.where(F.col("score") > tau).select("key", "nodes").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    rows = gold.where("expected = 'reasoned-supportable'").join(taken, "key", "left")
    return rows.agg(F.coalesce(F.avg(F.coalesce("k", F.lit(0))), F.lit(0.0)).alias("mean_multiplicity"))


def calibrate(gold: DataFrame, claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, taus: list[float], how: Grounding = Grounding()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole report from gold rows and their claims (key, text): see `report`, the summary with mean_multiplicity."""
    paths = stored(scored_paths(claims, nodes, edges, how))
    scores = stored(stage_scores(claims, nodes, edges, facts, how, paths))
    tau = choose_tau(gold, scores, taus)
    one, errors, curve = report(gold, scores, taus)
    many = mean_multiplicity(gold.where("fold = 'sweep'"), paths, taus[0] if tau is None else tau)
    return one.join(F.broadcast(many)), errors, curve


def report(gold: DataFrame, scores: DataFrame, taus: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """With tau chosen on the calibration fold, the sweep fold's summary (one row), error by modality, and reliability
    curve of the claims that a label was found in. A measure of nothing is 0."""
    tau = choose_tau(gold, scores, taus)
    rows = judged(gold.where("fold = 'sweep'"), scores, taus[0] if tau is None else tau)
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(of)), F.lit(0.0))
    yes, supported = F.lit(True), F.col("expected") == "reasoned-supportable"
    one = rows.agg(
        F.lit(tau).alias("tau"), F.count(F.lit(1)).alias("n"), share(~F.col("correct"), yes).alias("error"),
        share(F.col("adversarial") & (F.col("produced") == "fabricated"), F.col("adversarial")).alias("adversarial_accuracy"),
        share(supported & F.col("correct"), supported).alias("supportable_accuracy"), share(F.col("gated"), yes).alias("coverage"),
    )
    return one, modality_error(rows), reliability_curve(rows.where("gated"))
