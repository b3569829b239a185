"""Near-duplicate documents by min-max hashing over word shingles.

A document's set holds the 64-bit hashes of its distinct runs of ``shingle`` words (lower-cased in A-Z, cut at ASCII
white space); a document of fewer words has its whole sequence as its one shingle. One permutation of the hash space
gives two signature values, the least and the greatest image of the set, each equal between two sets with probability
their Jaccard similarity; so ``bands * rows`` values cost half as many hash evaluations. Equal bands make candidates,
and every link is decided on full sets: 100 * |A and B| >= ``percent`` * |A or B|.

How groups are kept from being compared pair by pair:

* documents with the same set are one class, represented by the least doc_id; only representatives go on;
* in a bucket, members are compared with one pivot, the member with the most company over all its buckets. Components of
  the links so far are then formed, and buckets that lie in one component are done. Others lose their pivot, which has
  been compared with all that it isn't connected with, and take the next one;
* after ``pivot_rounds`` rounds the members of a bucket that are still in different components are searched for links by
  their differences from what most of them have in common (`_rest_links`), so that no candidate is left out. This search
  is exact, so where a group is spread evenly just below the threshold its joined rows still grow with the square of the
  group, at a small fraction of all pairs: README has figures.

Of two sets with c common of u shingles in all, a permutation's least and greatest images both agree with probability
c (c - 1) / (u (u - 1)): the two ends of the union are different elements. So a pair of representatives shares no bucket
with probability (1 - (c (c - 1) / (u (u - 1)))^(rows / 2))^bands. At a similarity of 0.8 that is 2.2e-5 for 4 of 5
shingles, 5.4e-6 for 8 of 10, 2.0e-6 for 40 of 50 and 1.7e-6 for 400 of 500, and less above; with several paths between
copies it is less still.

Cases: null, empty and blank texts have no shingles and are linked with nothing; a very long text is hashed alone. A null
doc_id is linked with nothing: its component is null and it is kept. Rows with one doc_id are one node: any of their sets
links it; repeated rows are such rows. An empty table gives no rows. Other columns of the documents aren't read by
`near_duplicates`; `keep_one_of_each` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, hashed_words, hidden, mix, read_table, text_chunks, window_hashes
from .components import connected_components


@dataclass(frozen=True)
class NearDedup:
    shingle: int = 5
    percent: int = 80
    bands: int = 44
    rows: int = 6
    pivot_rounds: int = 2


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, in a row, and how many there are."""
    flat, starts, counts = hashed_words(texts, lower=True)
    windows = window_hashes(flat, k)
    sets = []
    for s, n in zip(starts.tolist(), counts.tolist()):
        if n >= k:
            sets.append(np.unique(windows[s : s + n - k + 1]))
        else:
            sets.append(mix(window_hashes(flat[s : s + n], n) + np.uint64(n)) if n else flat[:0])
    return (np.concatenate(sets) if sets else flat[:0]), np.fromiter(map(len, sets), np.int64, len(sets))


def _permutations(n: int) -> list[tuple[np.uint64, np.uint64]]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [(seed[2 * i] | np.uint64(1), seed[2 * i + 1]) for i in range(n)]


def band_keys(flat: np.ndarray, sizes: np.ndarray, how: NearDedup) -> np.ndarray:
    """One row of band keys for each set that isn't empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    values = how.bands * how.rows
    signature = np.empty((len(starts), values), np.uint64)
    for i, (a, b) in enumerate(_permutations((values + 1) // 2)):
        image = flat * a
        image += b
        image ^= image >> np.uint64(32)
        signature[:, 2 * i] = np.minimum.reduceat(image, starts)
        if 2 * i + 1 < values:
            signature[:, 2 * i + 1] = np.maximum.reduceat(image, starts)
    keys = np.zeros((len(starts), how.bands), np.uint64)
    parts = signature.reshape(len(starts), how.bands, how.rows)
    for r in range(how.rows):
        keys = mix(keys + parts[:, :, r] + np.uint64(r + 1))
    return mix(keys + np.arange(1, how.bands + 1, dtype=np.uint64))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signed(docs: DataFrame, how: NearDedup) -> DataFrame:
    """id, n (set size), f1, f2 (set fingerprint) and bands of each row of id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            flat, sizes = shingle_sets(batch.column(1).to_pylist(), how.shingle)
            some = sizes > 0
            starts = np.cumsum(sizes) - sizes
            prints = []
            for k in (1, 2):
                sums = np.zeros(len(sizes), np.uint64)
                if some.any():
                    sums[some] = np.add.reduceat(mix(flat + np.uint64(k)), starts[some])
                prints.append(pa.array(sums.view(np.int64)))
            keys = band_keys(flat, sizes, how) if some.any() else np.zeros((0, how.bands), np.uint64)
            bands = _lists(keys.reshape(-1), np.where(some, how.bands, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *prints, bands], names=["id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, how: NearDedup) -> DataFrame:
    """id and its shingle set as a sorted array, for rows of id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            flat, sizes = shingle_sets(batch.column(1).to_pylist(), how.shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(flat, sizes)], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, how: NearDedup) -> DataFrame:
    """Of pairs a, b those whose full sets are similar enough. Both joins are of plain exchanges, which Spark can split
    where a pivot is hot."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * how.percent).select("a", "b")


def _fits(x: Column, y: Column, how: NearDedup) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * how.percent


def _open(scratch: Scratch, name: str, members: DataFrame, comps: DataFrame | None) -> DataFrame | None:
    """Members, with their components, of the buckets that hold several components; None if there are none."""
    if comps is None:
        return members.withColumn("comp", F.col("id"))
    known = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    side = scratch.write(f"{name}-open", known.join(scratch.write(f"{name}-split", split), "key", "left_semi"))
    return None if side.isEmpty() else side


def _pivots(side: DataFrame) -> DataFrame:
    """The member of most weight of each bucket: key, pivot, pn (its set size), pcomp."""
    best = side.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n", "comp")).alias("p"))
    return best.select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pcomp"))


def _rest_links(scratch: Scratch, side: DataFrame, sets: DataFrame, links: DataFrame, how: NearDedup) -> DataFrame:
    """``links`` and links that connect what is linked inside the buckets of ``side``, without comparing all pairs.

    Members that share a bucket pivot are a group. Its centre is the set of the shingles that more than half of its members
    have, and a member x is told by its difference D(x), the shingles that only one of x and the centre has. Sets x and y
    differ by |D(x)| + |D(y)| - 2 |D(x) and D(y)| shingles, and they are linked if that is at most r (|x| + |y|), where
    r = (100 - percent) / (100 + percent). So a link needs ``need`` common differences:

        need(x, y) = (s(x) + s(y)) / 2, where s(x) = |D(x)| - r |x|

    If s(x) + s(y) <= 0, the two are linked whatever they share. The member of least s is then linked with both, so its own
    links of this kind connect all of them. For all other pairs need is above 0, and no shingle is a difference of more than
    half of the members. Differences are ordered by how many members have them, rare ones first; the first common one of a
    pair is among the first |D| - need + 1 of either, and after it enough must be left in both (prefix and position filters,
    both exact). Differences that one member has alone, as most edits are, meet nothing; neither do members of one component.

    A pair's prefix shrinks as its partner's difference grows, so members meet by class of s, classes being powers of two
    of the set's size: for each class of partners a member offers no more than the prefix that the least of them asks for.
    """
    q = how.percent
    pivots = scratch.write("rest-pivots", _pivots(side).select("key", "pivot"))
    group = scratch.write("rest-group", side.join(pivots, "key").select("pivot", "id").distinct())
    own = sets.select("id", "s").withColumn("mark", F.xxhash64("s"))
    # Members are sets, not ids, which may have several.
    held = scratch.write("rest-held", group.join(own, "id"))
    many = scratch.write("rest-many", held.groupBy("pivot").agg(F.count(F.lit(1)).alias("g")))
    common = held.select("pivot", F.explode("s").alias("token")).groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("k"))
    # At most as many as twice the mean size of the group's sets.
    centre = common.join(many, "pivot").where(F.col("k") * 2 > F.col("g")).groupBy("pivot").agg(F.collect_list("token").alias("c"))
    centre = scratch.write("rest-centre", many.select("pivot").join(centre, "pivot", "left").withColumn("c", F.coalesce("c", F.array().cast("array<long>"))))
    cut = held.join(centre, "pivot").select("pivot", "id", "mark", F.size("s").alias("n"), F.concat(F.array_except("s", "c"), F.array_except("c", "s")).alias("d"))
    # slack: (100 + percent) s(x), a whole number.
    cut = cut.withColumn("dn", F.size("d")).withColumn("slack", F.col("dn") * (100 + q) - F.col("n") * (100 - q))
    cut = scratch.write("rest-cut", cut)
    scratch.drop("rest-held")

    least = scratch.write("rest-least", cut.groupBy("pivot").agg(F.min(F.struct("slack", "id")).alias("l")).select("pivot", F.col("l.id").alias("head"), F.col("l.slack").alias("ls")))
    direct = cut.join(least, "pivot").where((F.col("slack") + F.col("ls") <= 0) & (F.col("id") != F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b"))
    links = scratch.write("rest-links", links.union(direct))
    comps = connected_components(scratch, "rest-direct", links)
    known = comps.select("id", "comp")
    lone = cut.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lone = lone.join(least.drop("ls"), "pivot").join(known.toDF("head", "hcomp"), "head", "left")
    # Of two members of different components one at least isn't in that of the head.
    lone = scratch.write("rest-placed", lone.withColumn("outside", F.col("comp") != F.coalesce("hcomp", "head")).drop("head", "hcomp"))
    scratch.drop("rest-cut")
    open_ = scratch.write("rest-open", lone.where("outside").select("pivot").distinct())
    member = ["pivot", "id", "mark"]
    facts = ["n", "dn", "slack", "comp", "outside"]
    told = scratch.write("rest-tokens", lone.join(open_, "pivot", "left_semi").select(*member, *facts, F.explode("d").alias("token")))
    often = scratch.write("rest-often", told.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    ranked = told.join(often, ["pivot", "token"], "left").groupBy(*member).agg(F.first(F.struct(*facts)).alias("m"), F.sort_array(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "token"))).alias("t"))
    ranked = scratch.write("rest-ranked", ranked.select(*member, "m.*", "t"))
    scratch.drop("rest-tokens")

    # Classes of slack. The least class holds all members of no positive slack; in class c > 0 it is 2^(c - 1) at least.
    level = F.when(F.col("slack") <= 0, F.lit(0)).otherwise(F.floor(F.log2(F.col("slack").cast("double"))).cast("int") + 1)
    ranked = ranked.withColumn("level", level)
    classes = scratch.write("rest-classes", ranked.groupBy("pivot", F.col("level").alias("other")).agg(F.min("slack").alias("floor"), F.count(F.lit(1)).alias("members")))
    asks = ranked.join(classes, "pivot").withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("slack") + F.col("floor")) / (2 * (100 + q)))))
    reach = F.least("dn", F.col("dn") - F.col("need") + 1)
    offered = asks.where(reach > 0).select("pivot", "other", "level", "id", *facts, F.posexplode(F.slice("t", F.lit(1), reach.cast("int"))).alias("i", "t"))
    offered = offered.where("t.k > 1").select("pivot", "other", "level", "id", *facts, "i", F.col("t.token").alias("token"))
    offered = scratch.write("rest-offered", offered)
    scratch.drop("rest-ranked")
    ask = offered.where("outside")
    theirs = offered.select("pivot", F.col("level").alias("other"), F.col("other").alias("level"), "token", *[F.col(c).alias(f"o{c}") for c in ("id", *facts, "i")])
    need = F.ceil((F.col("slack") + F.col("oslack")) / (2 * (100 + q)))
    apart = (F.col("comp") != F.col("ocomp")) & _fits(F.col("n"), F.col("on"), how) & (~F.col("ooutside") | (F.col("id") < F.col("oid")))
    met = ask.join(theirs, ["pivot", "other", "level", "token"]).where(apart & (F.least(F.col("dn") - F.col("i"), F.col("odn") - F.col("oi")) >= need))
    pairs = scratch.write("rest-pairs", met.select(F.least("id", "oid").alias("a"), F.greatest("id", "oid").alias("b")).distinct())
    return links.union(scratch.write("rest-found", _linked(pairs, sets, how)))


def near_duplicates(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """id, n_shingles and component of each row of doc_id, text, in any order.

    Aggregates that are joined back by their key are written first: a join of two plain exchanges is one that Spark can
    split where a key is hot.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = scratch.write("signed", _signed(rows, how))
    live = signed.where("id IS NOT NULL AND n > 0")
    classes = scratch.write("classes", live.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")))

    # Bucket members: representatives that share a band with another one.
    reps = live.join(classes.withColumnRenamed("rep", "id"), ["f1", "f2", "n", "id"], "left_semi").dropDuplicates(["id", "f1", "f2", "n"])
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = scratch.write("shared", banded.groupBy("key").agg(F.count(F.lit(1)).alias("company")).where("company > 1"))
    members = scratch.write("members", banded.join(shared, "key"))
    weight = scratch.write("weight", members.groupBy("id").agg(F.sum("company").alias("weight")))
    members = scratch.write("weighted", members.join(weight, "id").select("key", "id", "n", "weight"))
    scratch.drop("members")
    # The same join at every size: texts meet the ids by a shuffle, and no table of ids is broadcast.
    wanted = members.select("id").distinct()
    sets = scratch.write("sets", _sets(rows.join(wanted.hint("shuffle_hash"), "id", "left_semi"), how))

    grouped = signed.join(classes, ["f1", "f2", "n"], "left")
    grouped = grouped.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    grouped = scratch.write("grouped", grouped)
    # A doc_id that has several sets connects their classes.
    same_id = grouped.groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    links = scratch.write("same-id", same_id.select("a", F.explode("reps").alias("b")))
    comps = None
    for turn in range(how.pivot_rounds):
        side = _open(scratch, f"turn{turn}", members, comps)
        if side is None:
            break
        pivots = scratch.write(f"pivots{turn}", _pivots(side))
        met = side.join(pivots, "key")
        pairs = met.where((F.col("comp") != F.col("pcomp")) & _fits(F.col("n"), F.col("pn"), how))
        pairs = scratch.write(f"pairs{turn}", pairs.select("id", "pivot").distinct())
        links = links.union(scratch.write(f"found{turn}", _linked(pairs.toDF("a", "b"), sets, how)))
        comps = connected_components(scratch, f"turn{turn}", links)
        # A pivot has met all that it isn't connected with; the rest of its bucket goes on without it.
        members = scratch.write(f"members{turn}", met.where("id <> pivot").select("key", "id", "n", "weight"))
    side = _open(scratch, "rest", members, comps)
    if side is not None:
        comps = connected_components(scratch, "all", _rest_links(scratch, side, sets, links, how))

    out = grouped.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    return scratch.only("result", out.select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component")))


def keep_one_of_each(docs: DataFrame, how: NearDedup = NearDedup()) -> DataFrame:
    """The documents, with their own columns, of which each component keeps the one of the least doc_id.

    Of rows that share a doc_id one stays (the least text); rows with a null doc_id all stay.
    """
    found = near_duplicates(docs, how)
    docs, own = hidden(docs, "doc_id", "text")
    kept = found.where("id = component").groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__k"))
    kept = Scratch(docs.sparkSession, "near-dedup").write("kept", kept)
    named = docs.where("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"))
    if not kept.where("__k > 1").isEmpty():
        first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
        named = named.withColumn("__row", first).where("__row = 1")
    return named.select(*own).union(docs.where("doc_id IS NULL").select(*own))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, NearDedup(shingle=2))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
