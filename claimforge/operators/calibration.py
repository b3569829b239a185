"""Calibration of the grader on gold outcomes: error by modality, reliability bins, choice of tau.

Gold rows: expected, score, modality, adversarial, fold. A claim is produced as retrieved above tau, else fabricated;
scores don't depend on tau, so all candidates are judged from one pass over the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 5


def judged(gold: DataFrame, tau: float) -> DataFrame:
    """Adds produced, correct and margin."""
    out = gold.withColumn("produced", F.when(F.coalesce("score", F.lit(0.0)) > tau, F.lit("retrieved")).otherwise(F.lit("fabricated")))
    return out.withColumns({"correct": F.col("produced") == F.col("expected"), "margin": F.abs(F.coalesce("score", F.lit(0.0)) - tau)})


def modality_error(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    return out.withColumn("error", 1 - F.col("n_correct") / F.col("n"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: n, error, share of adversarial claims graded fabricated; a measure of nothing is 0."""
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(of)), F.lit(0.0))
    bad = F.col("adversarial")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        share(~F.col("correct"), F.lit(True)).alias("error"),
        F.count_if(bad).alias("n_adversarial"),
        share(bad & (F.col("produced") == "fabricated"), bad).alias("adversarial_accuracy"),
    )


def reliability_curve(rows: DataFrame) -> DataFrame:
    """Five bins of margin, the last one closed, all present: bin, n, accuracy."""
    edges = [(i, i * (1.0 / BINS), (i + 1) * (1.0 / BINS)) for i in range(BINS)]
    bins = rows.sparkSession.createDataFrame(edges, "bin int, lo double, hi double")
    number = F.lit(None).cast("int")
    for i, lo, hi in edges:
        inside = (F.col("margin") >= lo) & ((F.col("margin") <= hi) if i == BINS - 1 else (F.col("margin") < hi))
        number = F.when(inside, F.lit(i)).otherwise(number)
    counts = rows.select(number.alias("bin"), "correct").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("accuracy"))


def tau_accuracy(gold: DataFrame, taus: list[float]) -> DataFrame:
    """tau, n, n_correct of each candidate, in one pass."""
    rows = gold.select("expected", F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    hit = F.when(F.col("score") > F.col("tau"), F.col("expected") == "retrieved").otherwise(F.col("expected") == "fabricated")
    return rows.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_correct"))


def best_tau(gold: DataFrame, taus: list[float]) -> DataFrame:
    """One row: the tau of most correct claims, the least on ties."""
    best = tau_accuracy(gold, taus).agg(F.min(F.struct((-F.col("n_correct")).alias("minus"), "tau", "n")).alias("b"))
    return best.select(F.col("b.tau").alias("tau"), (-F.col("b.minus")).alias("n_correct"), F.col("b.n").alias("n"))


def completeness(gold: DataFrame) -> DataFrame:
    """One row: whether ids are unique, both folds are there, some item is adversarial, and each of those is expected to
    be fabricated."""
    ids = gold.groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.bool_or("adversarial").alias("a"), F.count_if(F.col("expected") == "fabricated").alias("f"))
    unique = ids.agg(F.max("k").alias("k"), F.count_if("a").alias("n_adversarial"), F.count_if(F.col("a") & (F.col("f") == 0)).alias("n_adversarial_unmarked"))
    folds = gold.agg(F.countDistinct("fold").alias("n_folds"))
    return unique.join(F.broadcast(folds)).select((F.col("k") == 1).alias("unique_ids"), "n_folds", "n_adversarial", "n_adversarial_unmarked")
