"""Falsifiable controls: what must hold of graded claims if grading means anything, counted on the plan that grades.

Each control names the claims it speaks of, which of them break it, and the share that may. The counts are observed metrics
of the graded table, so they are taken while it is written, without a second pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.lineage import stored

REPORT = "control string, n long, n_broken long, share double, limit double, green boolean"


@dataclass(frozen=True)
class Control:
    name: str
    #: Whether a graded claim is one of those that the control speaks of, and whether it breaks it; null counts as no.
    about: Column
    broken: Column
    #: The share of broken claims up to which the control is green. Without claims it is green.
    limit: float = 0.0


def observed(graded: DataFrame, controls: list[Control]) -> tuple[DataFrame, DataFrame]:
    """The graded claims, written, and a row for each control: n, n_broken, share, limit and green."""
    seen = Observation()
    counts = []
    for k, c in enumerate(controls):
        about = F.coalesce(c.about, F.lit(False))
        counts += [F.count_if(about).alias(f"n{k}"), F.count_if(about & F.coalesce(c.broken, F.lit(False))).alias(f"b{k}")]
    out = stored(graded.observe(seen, *counts))
    found, rows = seen.get, []
    for k, c in enumerate(controls):
        n, broken = found[f"n{k}"], found[f"b{k}"]
        share = broken / n if n else 0.0
        rows.append((c.name, n, broken, share, float(c.limit), share <= c.limit))
    return out, graded.sparkSession.createDataFrame(rows, REPORT)


def moved_claims(before: DataFrame, after: DataFrame, targeted: DataFrame) -> DataFrame:
    """key, moved (whether status, source, evidence or score differ between two gradings of the same claims) and targeted
    (whether the edit between them was meant for the claim, by key). A claim that one side lacks has moved."""
    told = ["status", "source", "evidence", "score"]
    left, right = (df.select("key", F.struct(*told).alias(n)) for df, n in ((before, "__b"), (after, "__a")))
    both = left.join(right, "key", "full_outer").join(targeted.select("key").distinct().withColumn("__t", F.lit(True)), "key", "left")
    return both.select("key", (~F.col("__b").eqNullSafe(F.col("__a"))).alias("moved"), F.coalesce("__t", F.lit(False)).alias("targeted"))


def strayed() -> Control:
    """Of `moved_claims`: an edit moves no claim that it wasn't meant for."""
    return Control("only_targeted_claims_move", ~F.col("targeted"), F.col("moved"))


def ungrounded(about: Column, limit: float) -> Control:
    """Claims known to be true are grounded, but for the grader's own error."""
    return Control("true_claims_are_grounded", about, F.col("status") == "fabricated", limit)


def believed(name: str, about: Column) -> Control:
    """Claims known to be false are fabricated."""
    return Control(name, about, F.col("status") != "fabricated")


def unsourced() -> Control:
    """Each grounded claim names its evidence and has a score, and no fabricated one names any."""
    bare = (F.col("evidence") == "") | F.col("evidence").isNull()
    return Control("grounded_claims_name_evidence", F.lit(True), F.when(F.col("status") == "fabricated", ~bare).otherwise(bare | F.col("score").isNull()))
