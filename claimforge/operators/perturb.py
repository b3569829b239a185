"""Ablation: contexts of an entity, withholding of triples and texts, manifests, and the sweep plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The conditions of a sweep.
CONDITIONS = ("full", "knowledge-absent", "content-absent", "image-absent", "full-no-edit-rerun")


def withhold_triples(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges without those that a reference (subject_id, property_id, object_id; null object: any) names."""
    r = refs.select(F.col("subject_id").alias("rs"), F.col("property_id").alias("rp"), F.col("object_id").alias("ro"))
    same = (edges.subject_id == r.rs) & (edges.property_id == r.rp) & (r.ro.isNull() | r.ro.eqNullSafe(edges.object_id))
    return edges.join(r, same, "left_anti")


def withhold_text(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with a null description where the entity (id) is named."""
    named = entities.select("id").distinct().withColumn("__gone", F.lit(True))
    out = nodes.join(named, "id", "left").withColumn("description", F.when(F.col("__gone").isNull(), F.col("description")))
    return out.drop("__gone")


def withhold_image(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with a null image_path where the entity (id) is named."""
    named = entities.select("id").distinct().withColumn("__gone", F.lit(True))
    out = nodes.join(named, "id", "left").withColumn("image_path", F.when(F.col("__gone").isNull(), F.col("image_path")))
    return out.drop("__gone")


def described(description: Column, facts: Column) -> Column:
    """A description with those facts appended, in order, that what is there so far doesn't hold yet."""
    return F.aggregate(
        facts,
        F.coalesce(description, F.lit("")),
        lambda acc, x: F.when(acc.contains(x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(". "), x)),
    )


def contexts(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """id, description (with text facts) and triples (outgoing, in edge order) of each node."""
    out = edges.groupBy(F.col("subject_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "property_label", "object_label"))), lambda e: F.struct(e["property_label"].alias("property"), e["object_label"].alias("value"))).alias("triples")
    )
    texts = facts.where("modality = 'text'").groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("label_ord", "fact"))), lambda x: x["fact"]).alias("facts"))
    joined = nodes.join(out, "id", "left").join(texts, "id", "left")
    none = F.array().cast("array<string>")
    return joined.select("id", "label", F.nullif(described(F.col("description"), F.coalesce("facts", none)), F.lit("")).alias("description"), "triples")


def contexts_of(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """The contexts of the entities asked for (id), each once, with image_path, which a full context never holds. Asking for
    an entity that isn't a node raises."""
    held = wanted.select("id").distinct().join(contexts(nodes, edges, facts).withColumn("__there", F.lit(True)), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no such entity: "), F.coalesce("id", F.lit("null"))))
    return held.select(F.when(F.col("__there"), F.col("id")).otherwise(missing).alias("id"), "label", "description", "triples", F.lit(None).cast("string").alias("image_path"))


def from_entries(entries: DataFrame) -> list[tuple[str, DataFrame]]:
    """Manifest entries (ord, type_name, entity_id, triples) as what `Perturbations.apply` takes: a kind and its rows, one
    kind after the other as they first occur. Withholding does not depend on order."""
    kinds = [r.type_name for r in entries.groupBy("type_name").agg(F.min("ord").alias("o")).orderBy("o").collect()]
    rows = {"knowledge_absence": entries.where("type_name = 'knowledge_absence'").select(F.explode("triples").alias("t")).select("t.*")}
    return [(k, rows[k] if k in rows else entries.where(F.col("type_name") == k).select(F.col("entity_id").alias("id"))) for k in kinds]


def prompt(label: Column, description: Column, triples: Column) -> Column:
    """The prompt of a context: ``label: description``, then ``- property: value`` lines."""
    lines = F.transform(triples, lambda t: F.concat(F.lit("- "), t["property"], F.lit(": "), t["value"]))
    head = F.when(description.isNotNull(), F.concat(label, F.lit(": "), description))
    told = F.concat_ws("\n", head, F.when(F.size(triples) > 0, F.array_join(lines, "\n")))
    return F.when(told == "", F.lit("(no context provided)")).otherwise(told)


def seed(item: Column, condition: Column, sample: Column) -> Column:
    """The draw's seed as text: the first 64 bits of sha256 of ``item|condition|sample``, which exceed a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", item, condition, sample.cast("string")), 256), 1, 16), 16, 10)


def sweep_plan(items: DataFrame, conditions: tuple[str, ...], draws: int) -> DataFrame:
    """item, condition, sample, run_id, seed, baseline_run_id: each item under each condition, ``draws`` times; each full
    run also has a rerun without an edit, unless that condition is asked for itself."""
    plan = items.select("item").withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))) if draws else items.select("item").limit(0).withColumn("condition", F.lit(""))
    plan = plan.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(max(draws, 1) - 1))))
    run = F.concat("item", F.lit("--"), "condition", F.lit("--s"), "sample")
    plan = plan.select("*", run.alias("run_id"), seed(F.col("item"), F.col("condition"), F.col("sample")).alias("seed"), F.lit(None).cast("string").alias("baseline_run_id"))
    if "full" not in conditions or "full-no-edit-rerun" in conditions:
        return plan
    rerun = plan.where("condition = 'full'").withColumns({"baseline_run_id": F.col("run_id"), "condition": F.lit("full-no-edit-rerun")})
    return plan.unionByName(rerun.withColumns({"run_id": run, "seed": seed(F.col("item"), F.col("condition"), F.col("sample"))}))


class Perturbations:
    """Named kinds of perturbation, each a function from nodes, edges and its entries to nodes, edges."""

    def __init__(self):
        self.kinds: dict[str, Callable] = {}

    def register(self, name: str):
        def keep(f: Callable) -> Callable:
            self.kinds[name] = f
            return f

        return keep

    def apply(self, nodes: DataFrame, edges: DataFrame, manifest: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """All entries in order; an unknown kind raises KeyError."""
        for name, entries in manifest:
            nodes, edges = self.kinds[name](nodes, edges, entries)
        return nodes, edges


REGISTRY = Perturbations()


@REGISTRY.register("knowledge_absence")
def _knowledge(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes, withhold_triples(edges, entries)


@REGISTRY.register("text_content_absence")
def _text(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return withhold_text(nodes, entries), edges


@REGISTRY.register("image_content_absence")
def _image(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return withhold_image(nodes, entries), edges


def default_perturbations(plan: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For plan rows (run_id, item entity, condition) what is withheld: references to all outgoing edges where knowledge is
    absent, and entities whose text is absent. Image absence has no default and raises."""
    fine = F.when(F.col("condition") == "image-absent", F.raise_error(F.lit("no default perturbation for image-absent"))).otherwise(F.col("condition"))
    rows = plan.withColumn("condition", fine)
    refs = rows.where("condition = 'knowledge-absent'").join(edges, F.col("entity") == F.col("subject_id"))
    return refs.select("run_id", "subject_id", "property_id", "object_id"), rows.where("condition = 'content-absent'").select("run_id", F.col("entity").alias("id"))


def gold_items(gold: DataFrame, fold: str | None = None, adversarial: bool | None = None, modality: str | None = None) -> DataFrame:
    """Gold rows of a fold, adversarial or not, or with an outcome of a modality."""
    rows = gold
    if fold is not None:
        rows = rows.where(F.col("fold") == fold)
    if adversarial is not None:
        rows = rows.where(F.col("adversarial") == F.lit(adversarial))
    return rows if modality is None else rows.where(F.col("modality") == modality)


def bank_items(bank: DataFrame, tier: str | None = None) -> DataFrame:
    """Items of a question bank, all or those of a tier."""
    return bank if tier is None else bank.where(F.col("tier") == tier)


def bank_tiers(bank: DataFrame) -> DataFrame:
    """The tiers that a bank has items of."""
    return bank.select("tier").distinct()
