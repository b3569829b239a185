"""Evidence search: the premise that scores best for each claim, by inverted indexes over values and tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blocked, overlap, tokens, values
from .containment import maybe_contained
from .graph import sieved
from .lineage import stored


def best_premise(claims: DataFrame, premises: DataFrame, place: bool = False, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """From key, text and pid, premise, ord: key, pid and score of the best premise, the first on ties; with ``place``
    its ord as well.

    Pairs without a common token score 0 and never win. A premise passes the value guard only if it holds every value of
    the claim, so a claim with values meets just the premises that hold the rarest part of them; other claims meet
    premises by their tokens: all of them in a task where premises are few, else rare ones first, as long as what is left
    could still win. Claims without a premise of positive score are absent.

    ``likely`` may say for sets of strings (parts, distinct) which premises to look at for claims with values: all that hold
    each string of some set, and any others.
    """
    # A table of a few files is read by as few tasks, and what takes long comes after.
    left = claims.select("key", "text").repartition("key").select("key", "text", tokens(F.col("text")).alias("ct"), values(F.col("text")).alias("cv"))
    # Values are in lower case, and a value inside a premise has each of its runs inside a run of the premise.
    left = stored(left.withColumn("parts", F.array_distinct(F.flatten(F.transform("cv", lambda v: _runs(v))))))
    scored = _by_value(left.where(F.size("parts") > 0), premises, likely)
    plain = left.where(F.size("parts") == 0)
    if not plain.isEmpty():
        # Without values there is no guard: premises of one set of tokens score alike, and the first of them stands for all.
        sets = premises.select("pid", "ord", F.sort_array(tokens(F.col("premise"))).alias("pt")).where(F.size("pt") > 0)
        sets = stored(sets.groupBy("pt").agg(F.min(F.struct("ord", "pid")).alias("m")).select("m.ord", "m.pid", "pt"))
        if (sets.agg(F.sum(F.size("pt"))).first()[0] or 0) <= BLOCK_TOKENS:
            scored = scored.unionByName(_by_block(plain.where(F.size("cv") == 0), sets))
            # What is left has values without letters and digits of ASCII.
            plain = plain.where(F.size("cv") > 0)
    if not plain.isEmpty():
        # What a premise is tested by is worked out once, before it meets any claim.
        right = premises.select("pid", "ord", F.lower("premise").alias("low"), values(F.col("premise")).alias("own"), tokens(F.col("premise")).alias("pt"))
        scored = scored.unionByName(_by_token(plain, stored(right)))
    best = _best(scored)
    return best.select("key", "pid", "score", *(["ord"] if place else []))


def _best(scored: DataFrame) -> DataFrame:
    """key, pid, ord and score of the best of each key, the first on ties."""
    best = scored.where("score > 0").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord", "pid")).alias("b"))
    return best.select("key", F.col("b.pid").alias("pid"), F.col("b.ord").alias("ord"), (-F.col("b.minus")).alias("score"))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


#: Tokens of distinct premises up to which these are sent to the tasks: inverted lists take 4 bytes for each.
BLOCK_TOKENS = 1_000_000

_held: dict[str, tuple[dict[str, np.ndarray], np.ndarray]] = {}


def _lists(key: str, sets: list[list[str]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The places of the sets that have a token, and the sizes of sets. A worker holds those that it served last."""
    if key not in _held:
        _held.clear()
        at: dict[str, list[int]] = {}
        for k, own in enumerate(sets):
            for t in own:
                at.setdefault(t, []).append(k)
        _held[key] = {t: np.array(v, np.int32) for t, v in at.items()}, np.array([len(own) for own in sets])
    return _held[key]


def _by_block(left: DataFrame, sets: DataFrame) -> DataFrame:
    """key, pid, ord and score of the best premise of claims without values, by how many tokens they share with each of the
    sets (ord, pid, pt)."""
    rows = sets.orderBy("ord", "pid").collect()
    spark, name = left.sparkSession, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast([r.pt for r in rows])
    places = spark.createDataFrame([(k, r.pid, r.ord) for k, r in enumerate(rows)], T.StructType([T.StructField("place", T.LongType()), sets.schema["pid"], sets.schema["ord"]]))
    schema = T.StructType([left.schema["key"], T.StructField("place", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, sizes), found = _lists(name, shared.value), []
            for k, own in enumerate(batch.column(1).to_pylist()):
                hits = [at[t] for t in own if t in at]
                if hits:
                    common = np.bincount(np.concatenate(hits), minlength=len(sizes))
                    score = common / (len(own) + sizes - common)
                    # The first of the best: sets are in order.
                    best = int(score.argmax())
                    found.append((k, best, float(score[best])))
            row, place, score = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(score, pa.float64())], names=schema.names)

    return left.select("key", "ct").mapInArrow(run, schema).join(F.broadcast(places), "place").select("key", "pid", "ord", "score")


#: Tokens of a claim that are looked up in the first round; each later round takes as many as all before it.
FIRST_TOKENS = 2


def _by_token(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, pid, ord and score of the best premise by common tokens.

    A claim's tokens are ordered by how many premises have them, rare ones first, those of none left out. A premise that has
    none of the first r of m shares m - r tokens at most, and so scores (m - r) / n at most for a claim of n tokens: a claim
    whose best reaches more is done. Words that all premises have come last and are looked up only for claims that nothing
    else decides. A premise of another size than the best score allows is dropped before it is scored.
    """
    index = stored(right.select("pid", "ord", F.size("pt").alias("np"), F.explode("pt").alias("token")))
    often = index.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    asked = left.select("key", F.size("ct").alias("nc"), F.explode("ct").alias("token")).join(often, "token")
    open_ = stored(asked.groupBy("key", "nc").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("ts")).withColumn("score", F.lit(0.0)))
    best, r, n = None, 0, FIRST_TOKENS
    while True:
        looked = open_.select("key", "nc", "score", F.explode(F.slice("ts", r + 1, n)).alias("t")).select("key", "nc", "score", F.col("t.token").alias("token"))
        met = looked.join(index, "token").where((F.col("np") >= F.col("score") * F.col("nc")) & (F.col("nc") >= F.col("score") * F.col("np")))
        pairs = met.select("key", "pid", "ord").distinct()
        full = pairs.join(left.select("key", "ct", "cv"), "key").join(right, ["pid", "ord"]).where(~blocked(F.col("low"), F.col("own"), F.col("cv")))
        found = full.select("key", "pid", "ord", overlap(F.col("pt"), F.col("ct")).alias("score"))
        best = stored(_best(found if best is None else found.unionByName(best)))
        r += n
        n = r
        left_over = open_.drop("score").where(F.size("ts") > r).join(best.select("key", "score"), "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        open_ = stored(left_over.where((F.size("ts") - r) / F.col("nc") >= F.col("score")))
        if open_.isEmpty():
            return best


def _by_value(left: DataFrame, premises: DataFrame, likely: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """key, pid, ord and score of the best premise among those that hold all parts of the claim's values. A premise that holds
    fewer parts than any claim has meets none. Claims of one text have one best premise, so a text meets premises once,
    however many claims have it."""
    asked = stored(left.groupBy("text").agg(*(F.first(c).alias(c) for c in ("ct", "cv", "parts"))))
    least = asked.agg(F.min(F.size("parts"))).first()[0] or 1
    right = (premises if likely is None else likely(stored(asked.select("parts").distinct()))).select("pid", "ord", "premise")
    held = maybe_contained(right.withColumn("low", F.lower("premise")), "low", asked.select(F.explode("parts").alias("part")))
    held = stored(held.where(F.size("parts") >= least).select("pid", "ord", "premise", F.col("parts").alias("held")))
    # The guard is dear, and few pairs come to it.
    near = stored(holding(held, asked, "text").select("text", "ct", "cv", "pid", "ord", "premise"))
    full = near.where(~blocked(F.lower("premise"), values(F.col("premise")), F.col("cv")))
    best = _best(full.select(F.col("text").alias("key"), "pid", "ord", overlap(tokens(F.col("premise")), F.col("ct")).alias("score")))
    return left.select("key", "text").join(best.withColumnRenamed("key", "text"), "text").select("key", "pid", "ord", "score")


def holding(held: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """The rows of ``held`` (held: strings) with those of ``asked`` (parts: strings; unique by the column ``by``) all of whose
    parts they hold. They meet by the part that the fewest rows hold; what has a part that no row holds meets none."""
    counts = held.select(F.explode("held").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    rare = asked.select(by, F.explode("parts").alias("part")).join(counts, "part", "left").groupBy(by).agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "part")).alias("m"))
    chosen = stored(rare.where("m.k > 0").select(by, F.col("m.part").alias("part")).join(asked, by))
    ids = chosen.select(F.col("part").alias("id")).distinct()
    # Parts that most rows hold are hardly ever the rarest of a set, and rows don't travel by them.
    spread = sieved(held.select("*", F.explode("held").alias("part")), "part", ids, ids.count())
    return spread.join(chosen, "part").where(F.size(F.array_except("parts", "held")) == 0)
