"""Hard negatives by distributed radix selection.

Each component x of a vector becomes floor(256 x), so scores (inner products with an anchor) are integers. For an anchor
and one of its positives, the negatives are the ``k`` first rows of other labels, by falling score and then by rising
vec_id, whose score lies between ``percent`` of the positive's score and that score itself.

A window is one anchor and positive. Each pass reads all rows in the partitions they lie in and scores them against a
block of anchors, whose number and bytes are bounded and which alone is broadcast; rows aren't shuffled.

1. Positives: a task holds the first ``k`` rows of each anchor's label; these meet by anchor.
2. Histograms: a task counts, for each window, the rows in each of ``buckets`` equal ranges of score. The sums of all tasks
   show the bucket in which the k-th row lies; it is cut into buckets again, and so on, digit by digit, until it and
   those above hold at most ``gather`` rows or one score. Where one score has more rows than that (copies of one vector),
   the ranges go on over vec_id.
3. Only rows at or above the bucket found are gathered, at most ``k`` a task and window, and the first ``k`` are taken.

What travels is counts by window and bucket, and at most ``k`` rows for each task and window, both cut down before the
shuffle; no group, however hot its label or vector, comes together in a task. The driver holds one block's anchors and
windows.

Cases: rows with a null label or vec_id, a null vector, or a null, NaN or infinite component take no part. A missing
component of a shorter vector is zero; an empty vector scores 0. Repeated rows are rows of their own, but rows of the
anchor's vec_id are never its positives. Scores beyond 64 bits count as the largest or least 64-bit number; below that they
are exact at any size. Anchors without a positive, and windows without a row, give nothing; neither does an empty table.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read_table


@dataclass(frozen=True)
class HardNegatives:
    #: Positives of an anchor, and negatives of a window.
    k: int = 5
    percent: int = 80
    buckets: int = 64
    #: Rows of a window that may be gathered from the bucket found and those above.
    gather: int = 64
    block_anchors: int = 4096
    block_bytes: int = 32_000_000


#: Entries of a matrix of scores, and of rows scored at once.
SCORES, ROWS = 2_000_000, 1000
_EXACT = float(1 << 53)
_LAST = np.iinfo(np.int64).max


def eligible(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)


def quantised(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of floor(256 x); shorter ones end in zeros."""
    sizes = np.asarray(column.value_lengths())
    values = np.floor(256.0 * np.asarray(column.flatten(), np.float64))
    out = np.zeros((len(sizes), max([0, *sizes.tolist()])))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def integer_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exact: as doubles where these hold them, else over Python's integers."""
    n = min(anchors.shape[1], rows.shape[1])
    a, x = anchors[:, :n], rows[:, :n]
    if not n or np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * n < _EXACT:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -_LAST - 1, _LAST).astype(np.int64)


def scored(batches: Iterable[pa.RecordBatch], anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """vec_ids and labels of some rows, the first of some anchors, and the scores of those anchors by those rows."""
    step = max(1, SCORES // ROWS)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, labels, x = np.asarray(part.column(0)), np.asarray(part.column(1)), quantised(part.column(2))
            for a in range(0, len(anchors), step):
                yield ids, labels, a, integer_scores(anchors[a : a + step], x)


def first_rows(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` of each group, by falling score and rising id."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


class Best:
    """The first ``k`` rows of each group so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = tuple(np.concatenate(x) for x in zip(self.rows, (group, score, ids)))
        keep = first_rows(*rows, self.k)
        self.rows = tuple(x[keep] for x in rows)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.rows], names=["g", "score", "id"])


_BEST = "g long, score long, id long"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each g over all tasks, with their rank."""
    order = W.partitionBy("g").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, block, how: HardNegatives) -> DataFrame:
    """g (the anchor's number), score and id of each anchor's positives, with their rank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels, anchors = block.value
        best = Best(how.k)
        floor = np.full(len(own), -_LAST - 1)  # the score of the k-th row so far
        for ids, theirs, a, s in scored(batches, anchors):
            upto = a + len(s)
            near = (labels[a:upto, None] == theirs) & (own[a:upto, None] != ids) & (s >= floor[a:upto, None])
            g, r = np.nonzero(near)
            if len(g):
                best.add(g + a, s[g, r], ids[r])
                many = np.bincount(best.rows[0], minlength=len(own)) >= how.k
                least = np.full(len(own), _LAST)
                np.minimum.at(least, best.rows[0], best.rows[1])
                floor[many] = least[many]
        yield best.batch()

    return _first(rows.mapInArrow(run, _BEST), how.k)


class Windows:
    """Of each window: its anchor, the positive's score, and the range of (distance below that score, vec_id) in which
    its last row lies. ``wanted`` rows of that range are still needed; a window that isn't open is settled."""

    def __init__(self, anchor: np.ndarray, top: np.ndarray, how: HardNegatives, ids: tuple[int, int]):
        least = np.array([-((-how.percent * int(p)) // 100) for p in top], np.int64)  # the least score in reach
        self.anchor, self.top, self.first_id, self.last_id = anchor, top, ids[0], ids[1]
        n = len(top)
        self.low, self.high = np.zeros(n, np.int64), top - least  # distances, both included
        self.id_low, self.id_high = np.full(n, ids[0]), np.full(n, ids[1])
        self.wanted = np.full(n, how.k)
        self.open = self.high >= 0
        self.empty = ~self.open

    def by_id(self) -> np.ndarray:
        return self.low == self.high

    def width(self, buckets: int) -> np.ndarray:
        """Of a bucket. Python's integers, since the ids may span 64 bits."""
        spans = np.where(self.by_id(), self.id_high.astype(object) - self.id_low.astype(object), self.high - self.low)
        return np.array([max(1, -(-(int(x) + 1) // buckets)) for x in spans], np.int64)

    def settle(self, window: int, bucket: int, before: int, inside: int, all_rows: int, width: int, how: HardNegatives) -> None:
        """Goes on in the bucket that holds the last row; ``before`` rows of the range lie above it."""
        if all_rows <= self.wanted[window]:
            self.open[window] = False  # the whole range is needed
            return
        if self.by_id()[window]:
            low = int(self.id_low[window]) + bucket * width
            self.id_low[window], self.id_high[window] = low, min(low + width - 1, int(self.id_high[window]))
            last = self.id_low[window] == self.id_high[window]
        else:
            low = int(self.low[window]) + bucket * width
            self.low[window], self.high[window] = low, min(low + width - 1, int(self.high[window]))
            last = self.low[window] == self.high[window] and self.first_id == self.last_id
        self.wanted[window] -= before
        self.open[window] = not last and inside + how.k - self.wanted[window] > how.gather

    def members(self, labels: np.ndarray, theirs: np.ndarray, a: int, s: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs of a window of ``which`` (numbers in rising order) and a row of another label inside its limits of
        score: window, row and distance."""
        anchor = self.anchor[which]
        from_, upto = np.searchsorted(anchor, [a, a + len(s)])
        lead = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[from_:upto]) + from_ if upto > from_ else which[:0]
        if not len(lead):
            return which[:0], which[:0], which[:0]
        many = np.diff(np.append(lead, upto))
        mine = anchor[lead] - a
        top, least = (f.reduceat(x[which[from_:upto]], lead - from_) for f, x in ((np.maximum, self.top), (np.minimum, self.top - self.high)))
        own = s[mine]
        g, r = np.nonzero((own >= least[:, None]) & (own <= top[:, None]) & (labels[anchor[lead], None] != theirs))
        each = many[g]
        w = which[np.repeat(lead[g] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        r = np.repeat(r, each)
        distance = self.top[w] - s[self.anchor[w] - a, r]
        inside = (distance >= 0) & (distance <= self.high[w])
        return w[inside], r[inside], distance[inside]


def _histogram(rows: DataFrame, block, windows: Windows, how: HardNegatives) -> DataFrame:
    """Of each open window the bucket of its last row: w, bucket, before, inside, all_rows."""
    state = rows.sparkSession.sparkContext.broadcast((windows, windows.width(how.buckets)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, anchors = block.value
        win, width = state.value
        by_id, counts, open_ = win.by_id(), np.zeros(len(win.top) * how.buckets, np.int64), np.flatnonzero(win.open)
        for ids, theirs, a, s in scored(batches, anchors):
            w, r, distance = win.members(labels, theirs, a, s, open_)
            held = (distance >= win.low[w]) & (~by_id[w] | ((ids[r] >= win.id_low[w]) & (ids[r] <= win.id_high[w])))
            w, r, distance = w[held], r[held], distance[held]
            # Unsigned: ids may span all 64 bits.
            far = np.where(by_id[w], ids[r].view(np.uint64) - win.id_low[w].view(np.uint64), (distance - win.low[w]).view(np.uint64))
            np.add.at(counts, w * how.buckets + (far // width[w].view(np.uint64)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at // how.buckets), pa.array(at % how.buckets), pa.array(counts[at])], names=["w", "bucket", "n"])

    sums = rows.mapInArrow(run, "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
    # At most as many rows a window as there are buckets.
    upto = F.sum("n").over(W.partitionBy("w").orderBy("bucket"))
    told = sums.withColumns({"upto": upto, "all_rows": F.sum("n").over(W.partitionBy("w"))})
    wanted = rows.sparkSession.createDataFrame([(int(w), int(windows.wanted[w])) for w in np.flatnonzero(windows.open)], "w long, wanted long")
    least = F.least("wanted", "all_rows")
    told = told.join(wanted, "w").where((F.col("upto") >= least) & (F.col("upto") - F.col("n") < least))
    return told.select("w", "bucket", (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("inside"), "all_rows")


def _gathered(rows: DataFrame, block, windows: Windows, how: HardNegatives) -> DataFrame:
    """The first rows of each window, of those at or above its bucket: g (the window), score, id and rank."""
    state = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, anchors = block.value
        win, best = state.value, Best(how.k)
        some = np.flatnonzero(~win.empty)
        for ids, theirs, a, s in scored(batches, anchors):
            w, r, distance = win.members(labels, theirs, a, s, some)
            held = (distance < win.high[w]) | (ids[r] <= win.id_high[w])
            w, r, distance = w[held], r[held], distance[held]
            best.add(w, win.top[w] - distance, ids[r])
        yield best.batch()

    return _first(rows.mapInArrow(run, _BEST), how.k)


def _block(spark: SparkSession, rows: DataFrame, table: list, ids: tuple[int, int], how: HardNegatives) -> DataFrame | None:
    """The result for the anchors in ``table``."""
    own, labels = (np.array([r[i] for r in table], np.int64) for i in (0, 1))
    anchors = quantised(pa.array([r[2] for r in table], pa.list_(pa.float64())))
    block = spark.sparkContext.broadcast((own, labels, anchors))
    found = sorted((r.g, r["rank"], r.score, r.id) for r in _positives(rows, block, how).collect())
    if not found:
        return None
    anchor, _, top, positive = (np.array(x, np.int64) for x in zip(*found))
    windows = Windows(anchor, top, how, ids)
    while windows.open.any():
        width, seen = windows.width(how.buckets), np.zeros(len(top), bool)
        for r in _histogram(rows, block, windows, how).collect():
            windows.settle(r.w, r.bucket, r.before, r.inside, r.all_rows, int(width[r.w]), how)
            seen[r.w] = True
        windows.open &= seen  # others have no row at all
    names = pa.Table.from_pydict({"g": np.arange(len(top)), "anchor_id": own[anchor], "positive_id": positive, "positive_score": top})
    names = spark.createDataFrame(names.to_pandas(), "g long, anchor_id long, positive_id long, positive_score long")
    return _gathered(rows, block, windows, how).join(names, "g").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def hard_negatives(vectors: DataFrame, anchors: DataFrame, how: HardNegatives = HardNegatives()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for rows and anchors of vec_id, label,
    embedding."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows, anchors = eligible(vectors), eligible(anchors)
    anchors = scratch.write("anchors", anchors.withColumn("place", F.monotonically_increasing_id()))
    n, size = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    parts = []
    if n:
        ids = tuple(rows.agg(F.min("vec_id"), F.max("vec_id")).first())
        blocks = -(-n // max(1, min(how.block_anchors, how.block_bytes // (8 * size + 8))))
        for b in range(blocks if ids[0] is not None else 0):
            # Places are dealt in turn inside each partition, so blocks are of about one size.
            table = anchors.where(F.pmod("place", F.lit(blocks)) == b).select("vec_id", "label", "embedding").collect()
            found = _block(spark, rows, table, ids, how) if table else None
            if found is not None:
                parts.append(scratch.write(f"block{b}", found))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5"""
