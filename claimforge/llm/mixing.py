"""Mixing sources to target weights by hash thresholds, without a sort of documents.

Each document has a 30-bit hash. Sizes are summed by source and the hash's first ten bits; the bucket in which a source's
budget ends is summed again by the next ten bits, and so on; the last bucket is taken or left, whichever comes nearer to
the budget. A document is taken ``floor(target / source size)`` times, and once more if its hash lies below its source's
threshold. The histograms hold at most 1024 rows a source and level, and what is known of the sources is written after
each level, so that a level's plan reads one small table.

Targets: sources in code point order, null last, weigh ``weights`` in turn and share ``total`` of all sizes; a target
stops at ``most`` times its source's size and the excess is shared by weight among the rest: the water level at which
targets and caps use up the total. The level is found by sums over the sources, raised until no more of them are full;
the sources are ranked in range partitions. No step holds all sources in one task, and all joins leave the choice of a
broadcast to Spark, which makes it by the size of the written table.

Cases: null and empty texts have size 0; a very long text is one row's work; null sources are a source of their own.
Documents with the same doc_id and text (repeated rows) have one hash and are taken alike. An empty table gives no rows.
Columns of the documents that have the name of a result are replaced by `mix_sources`; `repeat_documents` returns all
columns as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, hidden, native_word_count, read_table


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    total: float = 1.5
    most: int = 2


LEVEL_BITS, LEVELS = 10, 3
HASH_BITS = LEVEL_BITS * LEVELS
NEW = ["size", "source_size", "target", "copies", "taken"]


def mix_hash(doc_id: Column, text: Column) -> Column:
    """The first 30 bits of the md5 of doc_id, a colon and the text; nulls are empty."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(told.cast("binary")), 1, 8), 16, 10).cast("long"), 32 - HASH_BITS)


def _weighed(scratch: Scratch, sizes: DataFrame, how: Mix) -> DataFrame:
    """source, source_size, w and cap of each source; weights go round in the order of sources."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    ranked = scratch.write("ranked", ranked)
    part, mask = F.shiftright("n", 33), F.lit((1 << 33) - 1)
    # A row a partition, so that this window is as small as the job's number of tasks.
    counts = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    counts = counts.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))
    rank = F.col("before") + F.col("n").bitwiseAND(mask)
    weight = F.get(F.array(*map(F.lit, how.weights)), (rank % len(how.weights)).cast("int"))
    joined = ranked.withColumn("part", part).join(counts, "part")
    return scratch.write("weighed", joined.select("source", "source_size", weight.alias("w"), (F.col("source_size") * how.most).alias("cap")))


def water_level(weighed: DataFrame, how: Mix) -> float | None:
    """The words a unit of weight gets: full sources get their caps, and the rest of the total is shared by weight. None
    if all sources are full. The level only rises, and each pass but the last fills a source."""
    level, full = 0.0, None
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.count_if(over).alias("full"),
            F.sum(F.when(~over, F.col("w"))).alias("open"),
        ).first()
        if not row.open:
            return None
        if row.full == full:
            return level
        level, full = (row.all * how.total - (row.caps or 0)) / row.open, row.full


def source_targets(scratch: Scratch, sizes: DataFrame, how: Mix) -> DataFrame:
    """From source, source_size: also target, the words that the mix shall take of each source."""
    weighed = _weighed(scratch, sizes, how)
    level = water_level(weighed, how)
    cap = F.col("cap").cast("double")
    return weighed.select("source", "source_size", (cap if level is None else F.least(cap, F.lit(level) * F.col("w"))).alias("target"))


def source_thresholds(scratch: Scratch, narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """From rows source, size, h and the targets: source, source_size, target, copies, threshold."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budget = F.col("target") - F.col("copies") * F.col("source_size")
    state = targets.withColumn("copies", copies).withColumns({"budget": budget, "threshold": F.lit(0).cast("long"), "ended": F.lit(True)})
    state = scratch.write("level0", state)
    for level in range(LEVELS):
        shift, last = HASH_BITS - LEVEL_BITS * (level + 1), level == LEVELS - 1
        edge = state.where("ended").select(F.col("source").alias("src"), F.shiftright("threshold", shift + LEVEL_BITS).alias("edge"), "budget")
        rows = narrow.join(edge, F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("edge")))
        # The budget goes with the sums, whose groups have one each.
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
        sums = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("b")))
        # The bucket in which the budget ends; on the last level also whether taking it comes nearer than leaving it.
        found = sums.where(F.col("upto") >= F.col("budget")).groupBy(F.col("source").alias("src")).agg(F.min(F.struct("b", "upto", "n", "budget")).alias("e"))
        rest = F.col("e.budget") - (F.col("e.upto") - F.col("e.n"))
        found = found.select("src", F.col("e.b").alias("b"), rest.alias("rest"), (F.col("e.upto") - F.col("e.budget") < rest).alias("take"))
        state = state.drop("ended").join(found, F.col("source").eqNullSafe(F.col("src")), "left")
        new = F.shiftleft("b", shift) + (F.col("take").cast("int") if last else 0)
        state = state.select(
            "source", "source_size", "target", "copies", F.coalesce("rest", "budget").alias("budget"),
            F.coalesce(new.cast("long"), F.col("threshold")).alias("threshold"), F.col("b").isNotNull().alias("ended"),
        )
        state = scratch.write(f"level{level + 1}", state)
    return state.select("source", "source_size", "target", "copies", "threshold")


def mix_sources(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Adds size, source_size, target, copies (times that the mix takes the document) and taken (words taken)."""
    docs, own = hidden(docs.drop(*NEW), "doc_id", "source", "text")
    scratch = Scratch(docs.sparkSession, "mixing")
    size, h = native_word_count(F.col("text")), mix_hash(F.col("doc_id"), F.col("text"))
    narrow = scratch.write("sizes", docs.select("source", size.alias("size"), h.alias("h")))
    totals = scratch.write("totals", narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    found = scratch.only("thresholds", source_thresholds(scratch, narrow, source_targets(scratch, totals, how)))
    found = found.select(F.col("source").alias("__source"), "source_size", "target", F.col("copies").alias("__base"), "threshold")
    out = docs.withColumns({"size": size, "__h": h})
    out = out.join(found, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.col("__base") + (F.col("__h") < F.col("threshold")).cast("int")
    out = out.withColumns({"copies": copies, "taken": (F.col("size") * copies).cast("long")})
    return out.select(*own, *NEW)


def repeat_documents(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mixed documents, each as many times as it is taken, with their own columns."""
    inner, own = hidden(docs, "doc_id", "source", "text")
    mixed = mix_sources(inner, how).where(F.col("copies") > 0)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size,
  ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:8])::UBIGINT::BIGINT >> 2 AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0)) / sum(w) OVER after AS level,
  row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS n FROM s
  WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  after AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT arg_min(level, n) AS level FROM r WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, f.level * w) END AS target FROM r, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
c AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
e AS (SELECT b.source, arg_min(c.h + CASE WHEN upto - (target - copies * source_size) < target - copies * source_size - (upto - n) THEN 1 ELSE 0 END, c.h) AS threshold
  FROM b JOIN c ON c.source IS NOT DISTINCT FROM b.source WHERE upto >= target - copies * source_size GROUP BY b.source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN h < coalesce(threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source"""
