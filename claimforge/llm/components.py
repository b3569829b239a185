"""Connected components of a link table, by hooking and pointer jumping, with every round in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _roots(scratch: Scratch, name: str, parents: DataFrame) -> DataFrame:
    """Follows v -> p (p < v) to the end: v and its root. Each step halves the way that is left."""
    step = 0
    while True:
        nxt = parents.select(F.col("v").alias("p"), F.col("p").alias("__pp"))
        jumped = parents.join(nxt, "p", "left").select("v", F.coalesce("__pp", "p").alias("p"), F.col("__pp").isNotNull().alias("moved"))
        jumped = scratch.write(f"{name}-{step}", jumped)
        if step:
            scratch.drop(f"{name}-{step - 1}")
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        parents, step = jumped.drop("moved"), step + 1


def connected_components(scratch: Scratch, name: str, links: DataFrame) -> DataFrame:
    """From links a, b: id and comp (the least id that it is connected with) of every linked id.

    In a round each node hooks onto its least neighbour if that is less than itself, hooks are followed to their roots,
    and the links are carried over to the roots; links inside a root go. Few rounds are needed, and the links left shrink
    from round to round. Nothing is gathered on the driver.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.write(f"{name}-links", links)
    ids = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    comps, rounds = None, 0
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).where("p < v")
        # Written first: a join of two plain exchanges is one that Spark can split where a root is hot.
        parents = scratch.write(f"{name}-{rounds}-parents", parents)
        parents = _roots(scratch, f"{name}-{rounds}-roots", parents)
        old = ids.select("id", F.col("id").alias("comp")) if comps is None else comps
        comps = old.join(parents, old.comp == parents.v, "left").select("id", F.coalesce("p", "comp").alias("comp"))
        comps = scratch.write(f"{name}-{rounds}-comps", comps)
        up = parents.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        vp = parents.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        links = links.join(up, "a", "left").join(vp, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        links = links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = scratch.write(f"{name}-{rounds}-left", links)
        rounds += 1
        if links.isEmpty():
            return comps
