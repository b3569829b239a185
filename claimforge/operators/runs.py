"""Diagnostics of graded runs: status counts, means with standard errors, support frequency, pairs of runs.

Claims are never matched across runs by their ids, which have a meaning in one run only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import proportion_se

# The statuses of a claim.
STATUSES = ("retrieved", "reasoned-supportable", "fabricated")
NAMES = tuple(s.replace("-", "_") for s in STATUSES)


def status_counts(claims: DataFrame, *by: str) -> DataFrame:
    """One column for each status, zeros included, and total."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in zip(STATUSES, NAMES)]
    return claims.groupBy(*by).agg(*counts, F.count("status").alias("total"))


def status_rollup(claims: DataFrame, by: str = "condition") -> DataFrame:
    """``by``, status, n and level: claims of each value and status, zeros included (level 0), of each value (1, null
    status), and of all (3, both null)."""
    every = claims.select(by).distinct().withColumn("status", F.explode(F.array(*map(F.lit, STATUSES))))
    counts = claims.groupBy(by, "status").agg(F.count(F.lit(1)).alias("k"))
    cells = every.join(counts, every[by].eqNullSafe(counts[by]) & (every.status == counts.status), "left").select(every[by], every.status, F.coalesce("k", F.lit(0)).alias("k"))
    return cells.rollup(by, "status").agg(F.sum("k").alias("n"), F.grouping_id().cast("long").alias("level")).select(by, "status", "n", "level")


def run_fractions(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """run_id, condition and the share of each status; a run without claims has zeros."""
    counts = runs.join(status_counts(claims, "run_id"), "run_id", "left")
    shares = [F.coalesce(F.col(n) / F.greatest("total", F.lit(1)), F.lit(0.0)).alias(n) for n in NAMES]
    return counts.select("run_id", "condition", *shares, F.coalesce("total", F.lit(0)).alias("total"))


def status_means(runs: DataFrame, claims: DataFrame, *by: str) -> DataFrame:
    """Long form: status, mean over runs of the run's share (each run counts once), standard error, n_runs."""
    parts = run_fractions(runs, claims)
    long = parts.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(n).alias("share")) for s, n in zip(STATUSES, NAMES)])).alias("x"))
    out = long.groupBy(*by, "x.status").agg(F.avg("x.share").alias("mean"), F.count(F.lit(1)).alias("n_runs"))
    return out.select(*by, "status", "mean", proportion_se(F.col("mean"), F.col("n_runs")).alias("se"), "n_runs")


def support_frequency(runs: DataFrame, support: DataFrame) -> DataFrame:
    """item and the share of runs in which it supports a claim that isn't fabricated; support: run_id, item, status."""
    total = runs.agg(F.countDistinct("run_id").alias("n_runs"))
    seen = support.where("status <> 'fabricated' AND item IS NOT NULL").select("run_id", "item").distinct()
    return seen.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("item", "n", (F.col("n") / F.col("n_runs")).alias("frequency"))


def condition_contrast(means: DataFrame, base: str = "full") -> DataFrame:
    """Shift of each status' mean share under each other condition against ``base``."""
    full = means.where(F.col("condition") == base).select("status", F.col("mean").alias("base_mean"))
    other = means.where(F.col("condition") != base)
    return other.join(full, "status").select("condition", "status", (F.col("mean") - F.col("base_mean")).alias("shift"))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """claim_id of claims (claim_id, status) fabricated before and grounded after."""
    b, a = before.where("status = 'fabricated'").select("claim_id"), after.where("status <> 'fabricated'").select("claim_id")
    return b.join(a, "claim_id", "left_semi")


def agreement_quadrant(frequency: DataFrame, shift: DataFrame, high: float = 0.5, spread: float = 2.0) -> DataFrame:
    """item, quadrant from how often an item supports (frequency) and how much its absence shifts grades (shift, se); a
    shift counts beyond ``spread`` standard errors."""
    often, moves = F.col("frequency") >= high, F.abs("shift") > spread * F.col("se")
    name = F.when(often & moves, "load-bearing").when(often, "redundant-scaffold").when(moves, "hidden-dependency").otherwise("inert")
    return frequency.join(shift, "item").select("item", name.alias("quadrant"))


def find_run(runs: DataFrame, item: str, condition: str, sample: int) -> DataFrame:
    """The run of a draw, by the id that a sweep gives it."""
    return runs.where(F.col("run_id") == f"{item}--{condition}--s{sample}")


def first_runs(runs: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` runs in order of the given columns: the cap of a diagnosis over several runs."""
    return runs.orderBy(*order).limit(n)


def baseline_deltas(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """run_id, baseline_run_id, status and delta: the share of each status in a run less that in its baseline run; runs
    whose baseline isn't there are left out."""
    shares = run_fractions(runs, claims).select("run_id", *NAMES)
    base = shares.select(F.col("run_id").alias("baseline_run_id"), *[F.col(n).alias(f"base_{n}") for n in NAMES])
    pairs = runs.where("baseline_run_id IS NOT NULL").select("run_id", "baseline_run_id").join(shares, "run_id").join(base, "baseline_run_id")
    deltas = F.array(*[F.struct(F.lit(s).alias("status"), (F.col(n) - F.col(f"base_{n}")).alias("delta")) for s, n in zip(STATUSES, NAMES)])
    return pairs.select("run_id", "baseline_run_id", F.explode(deltas).alias("x")).select("run_id", "baseline_run_id", "x.*")


def grounded_count(claims: DataFrame, *by: str) -> DataFrame:
    """The number of claims that aren't fabricated."""
    return claims.groupBy(*by).agg(F.count_if(F.col("status") != "fabricated").alias("grounded"))


def readable_shift(contrast: DataFrame, errors: DataFrame) -> DataFrame:
    """Shifts (modality, shift) with whether they exceed the grader's own error (modality, error): the noise floor. A
    modality of unknown error can't be read."""
    known = errors.select("modality", "error")
    return contrast.join(known, "modality", "left").withColumn("readable", F.coalesce(F.abs("shift") > F.col("error"), F.lit(False)))


def coverage_gauge(claims: DataFrame, *by: str) -> DataFrame:
    """fabricated claims (status, unresolved), how many of them name what the graph doesn't hold, and that share."""
    bad = F.col("status") == "fabricated"
    out = claims.groupBy(*by).agg(F.count_if(bad).alias("fabricated"), F.count_if(bad & (F.size("unresolved") > 0)).alias("out_of_slice"))
    return out.withColumn("share", F.coalesce(F.try_divide("out_of_slice", "fabricated"), F.lit(0.0)))
