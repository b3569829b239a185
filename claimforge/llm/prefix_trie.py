"""A prefix trie over conversations by partition refinement.

All conversations start in one class, the root. A class at depth d is split by the next turn: its members with the same
turn form a class at depth d + 1, one node of the trie. Classes of one member are retired: what is left of that
conversation is a unary chain, which is written out at the end without further splits. Then sums are folded back from the
leaves to the root.

How it is spread out:

* a turn is told by the digest of all turns up to it, so a class is a digest, and splitting is a count by digest, combined
  before the shuffle; a class that a third of all conversations share is one row a task;
* a round splits by a block of turns, each twice as long as the last, so that long equal conversations take a number of
  rounds that grows with the logarithm of their length. Only turns of members of classes still active are read;
* nodes with the same smallest member are one path of the trie. In a round of the fold all paths without unfinished side
  paths are summed from their ends and added where they leave their parents;
* the digest over the members that end in a node is made in two steps: range partitions of sorted members write pieces of
  text, and one task runs over a node's pieces in order, holding one at a time.

Turns of one conversation are sorted and hashed in one task, in batches; no class, path or list comes together otherwise.
Every round is a written table.

Cases: turns are ordered by turn, role and text, null first; a null role or text is empty; repeated rows are repeated
turns. Rows with a null conv_id are in no conversation. An empty table has no node, not even a root. Very long texts are one
row's work. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, native_word_count, read_table


@dataclass(frozen=True)
class PrefixTrie:
    #: Turns of the first block; each later one is twice as long.
    block: int = 4
    #: Bytes of a piece of a node's list of members.
    piece_bytes: int = 1 << 16


ROOT = b""
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0, in order), role and text of each turn."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("i"), "role", "text")


def _digest(role: Column, text: Column) -> Column:
    """Of a turn; the length of the role tells where the text starts."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth (from 1), p (digest of all turns up to this one), pp (of those before), words and last (whether the
    conversation ends here) of rows conv_id, i, role, text."""
    rows = turns.select("conv_id", "i", _digest(F.col("role"), F.col("text")).alias("own"), native_word_count(F.col("text")).alias("words"))
    size = F.max("i").over(W.partitionBy("conv_id"))
    rows = rows.repartition("conv_id").withColumn("last", F.col("i") == size).sortWithinPartitions("conv_id", "i").select("conv_id", "i", "own", "words", "last")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = p = None
        for batch in batches:
            before, after = [], []
            for c, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if c != conv:
                    conv, p = c, ROOT
                before.append(p)
                p = hashlib.blake2b(p + own, digest_size=16).digest()
                after.append(p)
            depth = pa.compute.add(batch.column(1), pa.scalar(1, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), depth, pa.array(after, pa.binary()), pa.array(before, pa.binary()), batch.column(3), batch.column(4)], names=["conv", "depth", "p", "pp", "words", "last"])

    return rows.mapInArrow(run, "conv long, depth int, p binary, pp binary, words long, last boolean")


def _refined(scratch: Scratch, turns: DataFrame, n: int, how: PrefixTrie) -> tuple[DataFrame | None, DataFrame]:
    """Nodes of several members below the root (p, pp, depth, rep: the smallest member, n, words), None if there are
    none; and for each conversation retired the first node that it has alone (p, pp, depth, conv)."""
    active, low, size, nodes, alone = None, 0, how.block, [], []
    while n > 1:
        block = turns.where((F.col("depth") > low) & (F.col("depth") <= low + size))
        if active is not None:
            block = block.join(active, "conv", "left_semi")
        block = scratch.write(f"block{low}", block)
        classes = block.groupBy("depth", "p").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("pp").alias("pp"), F.first("words").alias("words"))
        classes = scratch.write(f"classes{low}", classes)
        nodes.append(classes.where("n > 1").select("p", "pp", "depth", "rep", "n", "words"))
        first = classes.where("n = 1").groupBy(F.col("rep").alias("conv")).agg(F.min(F.struct("depth", "p", "pp")).alias("at"))
        alone.append(first.select("at.p", "at.pp", "at.depth", "conv"))
        low, bottom = low + size, block.where(F.col("depth") == low + size)
        # Plain scans on both sides, so that Spark can split the join where a class is hot.
        active = scratch.write(f"active{low}", bottom.join(classes.where((F.col("depth") == low) & (F.col("n") > 1)).select("p"), "p", "left_semi").select("conv"))
        size *= 2
        if active.isEmpty():
            break
    union = lambda parts: None if not parts else parts[0] if len(parts) == 1 else union(parts[:-1]).union(parts[-1])
    if n == 1:
        return None, None
    return union(nodes), union(alone)


def _folded(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """rep, depth, leaves and saved (over the subtree) from nodes rep, depth, up_rep, up_depth (their parents), leaves and
    saved (their own, with chains)."""
    begins = F.col("up_rep").isNull() | (F.col("up_rep") != F.col("rep"))
    pending = nodes.select("rep", "depth", "leaves", "saved")
    links = scratch.write("links", nodes.where(begins).select("rep", "up_rep", "up_depth"))
    done, turn = None, 0
    while True:
        ready = links.join(links.select(F.col("up_rep").alias("rep")).where("rep IS NOT NULL").distinct(), "rep", "left_anti")
        ready = scratch.write(f"ready{turn}", ready)
        if ready.isEmpty():
            return done
        order = W.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
        ended = pending.join(ready.select("rep"), "rep", "left_semi")
        ended = ended.select("rep", "depth", F.sum("leaves").over(order).alias("leaves"), F.sum("saved").over(order).alias("saved"))
        ended = scratch.write(f"ended{turn}", ended)
        done = ended if done is None else done.union(ended)
        top = ended.groupBy("rep").agg(F.max(F.struct((-F.col("depth")).alias("up"), "leaves", "saved")).alias("t")).select("rep", "t.leaves", "t.saved")
        added = ready.where("up_rep IS NOT NULL").join(top, "rep").groupBy(F.col("up_rep").alias("rep"), F.col("up_depth").alias("depth"))
        added = added.agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
        rest = pending.join(ready.select("rep"), "rep", "left_anti").join(added, ["rep", "depth"], "left")
        rest = rest.select("rep", "depth", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        pending = scratch.write(f"pending{turn}", rest)
        links = scratch.write(f"links{turn}", links.join(ready.select("rep"), "rep", "left_anti"))
        turn += 1


def listed_digests(members: DataFrame, how: PrefixTrie = PrefixTrie()) -> DataFrame:
    """p and sha (SHA-256 of the numbers, rising and comma-joined) of each p in rows p, conv."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "first", "piece"]
        row = lambda p, held: pa.RecordBatch.from_arrays([pa.array([p], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=names)
        at, held = None, []
        for batch in batches:
            for p, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (p != at or len(held) * 8 >= how.piece_bytes):
                    yield row(at, held)
                    held = []
                at = p
                held.append(conv)
        if held:
            yield row(at, held)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, found = None, None, []
        for batch in batches:
            for p, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if p != at or sha is None:
                    if sha is not None:
                        found.append((at, sha.hexdigest()))
                    at, sha = p, hashlib.sha256()
                    sha.update(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            if len(found) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["p", "sha"])
                found = []
        if sha is not None:
            found.append((at, sha.hexdigest()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found])], names=["p", "sha"])

    sorted_ = members.select("p", "conv").repartitionByRange("p", "conv").sortWithinPartitions("p", "conv")
    parts = sorted_.mapInArrow(pieces, "p binary, first long, piece string")
    return parts.repartition("p").sortWithinPartitions("p", "first").mapInArrow(digests, "p binary, sha string")


def prefix_trie(turns: DataFrame, convs: DataFrame, how: PrefixTrie = PrefixTrie()) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, i from 0, role, text) of the conversations in ``convs`` (conv_id,
    distinct): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256."""
    scratch = Scratch(turns.sparkSession, "trie")
    convs = scratch.write("convs", convs)
    turns = scratch.write("turns", _prefixes(turns))
    n, least = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    ends = turns.where("last").select("conv", F.col("depth").alias("len"))
    lens = convs.select(F.col("conv_id").alias("conv")).join(ends, "conv", "left").select("conv", F.coalesce("len", F.lit(0)).alias("len"))
    lens = scratch.write("lens", lens)
    many, alone = _refined(scratch, turns, n, how)
    if many is None:  # one conversation, or none: the root is alone
        chains = lens.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up_rep"), "len")
        return scratch.only("result", _chains(chains))

    root = turns.sparkSession.createDataFrame([(ROOT, None, 0, least, n, 0)], many.schema)
    many = scratch.write("many", many.union(root))
    parents = many.select(F.col("p").alias("pp"), F.col("rep").alias("up_rep"), F.col("depth").alias("up_depth"))
    alone = scratch.write("alone", alone.join(parents, "pp").join(lens, "conv").select("conv", "depth", "up_rep", "up_depth", "len"))
    placed = scratch.write("placed", many.join(parents, "pp", "left").select("p", "rep", "depth", "n", "words", "up_rep", "up_depth"))

    below = [d.where("up_rep IS NOT NULL").groupBy(F.col("up_rep").alias("rep"), F.col("up_depth").alias("depth")).agg(F.count(F.lit(1)).alias(c)) for d, c in ((placed, "__many"), (alone, "__alone"))]
    joined = placed
    for k, b in enumerate(below):
        joined = joined.join(scratch.write(f"below{k}", b), ["rep", "depth"], "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("__many", "__alone")})
    joined = joined.withColumns({
        "children": F.col("__many") + F.col("__alone"), "saved": (F.col("n") - 1) * F.col("words"),
        "leaves": F.when(F.col("__many") + F.col("__alone") == 0, F.lit(1)).otherwise(F.col("__alone")).cast("long"),
    })
    own = scratch.write("own", joined.drop("__many", "__alone"))
    sums = scratch.write("sums", _folded(scratch, own))

    ended = turns.where("last").select("p", "conv").join(own.where("depth > 0").select("p"), "p", "left_semi")
    ended = ended.union(lens.where("len = 0").select(F.lit(ROOT).alias("p"), "conv"))
    shas = scratch.write("shas", listed_digests(ended, how))
    nodes = own.drop("leaves", "saved").join(sums, ["rep", "depth"]).join(shas, "p", "left").select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up_rep").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return scratch.only("result", nodes.union(_chains(alone)))


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes that one conversation has alone, from depth to len."""
    rows = alone.select("*", F.explode(F.sequence("depth", "len")).alias("d"))
    own = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("up_rep")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("len"), own).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, i, role, text) and conversations (conv_id) of the contract: the first h turns of conversation c - c
    mod 20 (all if fewer), then c's own after its first h; h is the crc32 of c's digits mod 4."""
    scratch = Scratch(conversations.sparkSession, "rebuilt")
    turns = scratch.write("turns", numbered_turns(conversations))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    sizes = scratch.write("sizes", turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("size")))
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("giver"))
    given = sizes.select(F.col("conv_id").alias("giver"), F.col("size").alias("given"))
    convs = scratch.write("convs", convs.join(given, "giver", "left").select("conv_id", "h", "giver", F.least("h", F.coalesce("given", F.lit(0))).alias("given")))
    heads = turns.where("i < 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("giver"), "i", "role", "text")
    head = convs.where("given > 0").join(heads, "giver").where("i < given").select("conv_id", "i", "role", "text")
    own = turns.join(convs, "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("given")).alias("i"), "role", "text")
    return head.union(own), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt_turns(read_table(spark, sf_dir, "conversations")))


#: DuckDB has no crc32, so it is worked out bit by bit over a number's digits.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS size, conv_id - conv_id % 20 AS giver,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(9 * length(conv_id::VARCHAR)),
                   lambda k: CASE WHEN k % 9 = 0 THEN ascii(substr(conv_id::VARCHAR, (k // 9 + 1)::INTEGER, 1))::BIGINT ELSE -1 END)),
                 lambda z, x: CASE WHEN x >= 0 THEN xor(z, x) ELSE xor(z >> 1, (z & 1) * 3988292384) END), 4294967295) % 4 AS h
      FROM t GROUP BY conv_id),
g AS (SELECT c.conv_id, c.h, c.giver, least(c.h, coalesce(o.size, 0)) AS given FROM c LEFT JOIN c o ON o.conv_id = c.giver),
r AS (SELECT g.conv_id, t.i + 1 AS d, role, text FROM g JOIN t ON t.conv_id = g.giver AND t.i < g.given
      UNION ALL SELECT g.conv_id, t.i - g.h + g.given + 1, role, text FROM g JOIN t USING (conv_id) WHERE t.i >= g.h),
m AS (SELECT conv_id, d, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS p,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT *, lag(p) OVER w AS pp, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
n AS (SELECT d, p, any_value(pp) AS pp, min(conv_id) AS rep, count(*) AS n, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY d, p),
k AS (SELECT a.*, b.rep AS up, coalesce(o.k, 0) AS k FROM n a LEFT JOIN n b ON b.d = a.d - 1 AND b.p = a.pp
      LEFT JOIN (SELECT d - 1 AS d, pp, count(*) AS k FROM n GROUP BY ALL) o ON o.d = a.d AND o.pp = a.p),
s AS (SELECT m.d, m.p, count(*) FILTER (WHERE k.k = 0) AS leaves, sum((k.n - 1) * k.words) AS saved
      FROM k JOIN m ON m.conv_id = k.rep AND m.d <= k.d GROUP BY m.d, m.p)
SELECT rep AS conv_id, d::BIGINT AS depth, up AS parent_conv_id, n AS n_convs, k::BIGINT AS n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, ends_sha256
FROM k JOIN s USING (d, p)"""
