"""The older grading of slices: paths between all pairs of entities, a value guard that knows entity labels, and reasons
on fabricated claims. Claims meet all premises that share a word: for small graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocked, tokens, values
from ..operators.graph import all_paths, steps, with_edges
from ..operators.lineage import cut
from ..operators.linking import contained_pairs
from .cascade import Grounding, edge_premises, told_paths

# What a fabricated claim's reason says.
REJECTED = "value-sensitive gate rejected a candidate (wrong value)"
NEAREST = {"d": "best direct triple score", "c": "best content label score", "h": "best path score"}


def open_values(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, text, and cv: the claim's values without those that are an entity's label or hold one of over three letters."""
    rows = claims.select("key", "text", values(F.col("text")).alias("cv"))
    asked = rows.select(F.explode("cv").alias("key")).distinct().withColumn("norm", F.col("key"))
    labels = nodes.select("id", F.lower("label").alias("label")).where("label <> ''")
    inside = F.col("norm").contains(F.col("label")) & (F.length("label") > 3)
    named = contained_pairs(asked, labels).where((F.col("norm") == F.col("label")) | inside).select(F.col("key").alias("v")).distinct()
    kept = rows.select("key", F.explode("cv").alias("v")).join(named, "v", "left_anti").groupBy("key").agg(F.collect_list("v").alias("cv"))
    return claims.select("key", "text").join(kept, "key", "left").withColumn("cv", F.coalesce("cv", F.array().cast("array<string>")))


def premises(nodes: DataFrame, edges: DataFrame, facts: DataFrame, hops: int) -> DataFrame:
    """stage (d, c, h), pid, ord and premise of all triples, facts and paths."""
    direct = edge_premises(nodes, edges).select(F.lit("d").alias("stage"), "pid", "ord", "premise")
    content = facts.select(F.lit("c").alias("stage"), F.col("entity_id").alias("pid"), F.col("label_ord").cast("long").alias("ord"), F.col("fact").alias("premise"))
    paths = told_paths(with_edges(all_paths(steps(edges), hops), edges), nodes, "nodes", "path")
    return direct.withColumn("ord", F.col("ord").cast("long")).unionByName(content).unionByName(paths.select(F.lit("h").alias("stage"), F.array_join("nodes", ">").alias("pid"), F.lit(0).cast("long").alias("ord"), "premise"))


def legacy_grade(claims: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, how: Grounding = Grounding()) -> DataFrame:
    """key, status, source, evidence, score, spurious_path and spurious_reason of each claim (key, text). A fabricated claim
    is spurious if the value guard turned a premise down or one scored up to tau. Claims without a word have no evidence."""
    left = cut(open_values(claims, nodes).withColumn("ct", tokens(F.coalesce("text", F.lit("")))))
    right = cut(premises(nodes, edges, facts, how.hops).select("stage", "pid", "ord", F.lower("premise").alias("low"), values(F.col("premise")).alias("own"), tokens(F.col("premise")).alias("pt")))
    by = ["stage", "pid", "ord"]
    met = left.select("key", F.explode("ct").alias("t")).join(right.select(*by, F.explode("pt").alias("t")), "t").groupBy("key", *by).agg(F.count(F.lit(1)).alias("both"))
    rows = met.join(left, "key").join(right, by)
    score = F.col("both") / (F.size("ct") + F.size("pt") - F.col("both"))
    rows = rows.select("key", *by, score.alias("score"), blocked(F.col("low"), F.col("own"), F.col("cv")).alias("no"))
    best = rows.groupBy("key", "stage").agg(F.min(F.when(~F.col("no"), F.struct((-F.col("score")).alias("minus"), "ord", "pid"))).alias("b"), F.bool_or("no").alias("no"))
    wide = best.groupBy("key").agg(*[F.first(F.when(F.col("stage") == x, F.col("b")), ignorenulls=True).alias(x) for x in NEAREST], F.bool_or("no").alias("no"))
    s = {x: F.coalesce(-F.col(f"{x}.minus"), F.lit(0.0)) for x in NEAREST}
    rows = claims.select("key").join(wide, "key", "left")
    pick = lambda d, c, h, none: F.when(s["d"] > how.tau, d).when(s["c"] > how.tau, c).when(s["h"] > how.tau, h).otherwise(none)
    near = F.greatest(*s.values())
    told = lambda x: F.concat(F.lit(NEAREST[x]), F.format_string(" %.3f below tau ", s[x]), F.lit(str(how.tau)))
    nearest = F.when((s["d"] >= s["c"]) & (s["d"] >= s["h"]), told("d")).when(s["c"] >= s["h"], told("c")).otherwise(told("h"))
    reason = F.when(near > how.tau, None).when(F.col("no"), F.lit(REJECTED)).when(near > 0, nearest)
    lit = F.lit
    return rows.select(
        "key", pick(lit("retrieved"), lit("retrieved"), lit("reasoned-supportable"), lit("fabricated")).alias("status"),
        pick(lit("direct_triple"), lit("text_content"), lit("multi_hop_path"), lit("none")).alias("source"),
        pick(F.col("d.pid"), F.col("c.pid"), F.col("h.pid"), lit("")).alias("evidence"),
        pick(s["d"], s["c"], s["h"], F.nullif(near, lit(0.0))).alias("score"), reason.isNotNull().alias("spurious_path"), reason.alias("spurious_reason"),
    )
