"""Nearest neighbours of vectors by inverted lists: candidates for linkers and scorers that compare embeddings.

Centres are fitted on a bounded sample; every row goes to the list of its nearest centre, and a query looks into the lists
of its nearest ones. How many is chosen on the sample, as the least number that finds ``recall`` of the exact neighbours
of some of its rows. Lists of many rows are dealt into parts of ``part_rows`` by a hash of the id, and queries likewise, so
that a task holds two bounded sides however hot a list is; of each query it keeps the ``k`` best.

Cases: rows with a null id, a null or empty vector, or a component that is null, NaN or infinite are in no list; shorter
vectors end in zeros. Repeated rows are rows of their own; a query isn't its own neighbour. Ties go to the least id. Scores
are inner products of unit vectors; a zero vector scores 0 with all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import stored


@dataclass(frozen=True)
class Neighbours:
    k: int = 5
    #: Rows that centres are fitted on, at most, and rows of these that the number of lists is measured with.
    sample: int = 20_000
    measured: int = 200
    recall: float = 0.97
    rounds: int = 8
    part_rows: int = 20_000


def unit(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of a list column as rows of length 1; shorter ones end in zeros, longer ones are cut at ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), max([width, *sizes.tolist()])))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(column.flatten(), np.float64)
    out = out[:, :width]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the n nearest centres of each row, the nearest first."""
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]


def usable(rows: DataFrame) -> DataFrame:
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND size(embedding) > 0").where(good)


def fit(rows: DataFrame, how: Neighbours = Neighbours()) -> Index | None:
    """Centres and the number of lists to look into, from the sample; None without rows."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None
    # A hash of the id decides who is sampled: the same rows in each run, whatever their places.
    share = rows if n <= how.sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * how.sample / n))
    table = share.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).toArrow()
    x = unit(table.column("embedding"), width)
    lists = max(1, int(np.sqrt(len(x)) / 2))
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(how.rounds):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    index = Index(centres, lists)
    asked = x[:: max(1, len(x) // how.measured)]
    scores = asked @ x.T
    best = np.argsort(-scores, axis=1, kind="stable")[:, 1 : how.k + 1]
    order, own = index.nearest(asked, lists), (x @ centres.T).argmax(axis=1)
    # The place, in a query's order of lists, of the list that holds each exact neighbour.
    place = np.argmax(order[:, None, :] == own[best][:, :, None], axis=2)
    probes = next(p for p in range(1, lists + 1) if place.size == 0 or (place < p).mean() >= how.recall)
    return Index(centres, probes)


def neighbours(queries: DataFrame, rows: DataFrame, index: Index, how: Neighbours = Neighbours()) -> DataFrame:
    """vec_id (of the query), rank, neighbour_id and score of the ``k`` nearest rows in the lists looked into."""
    width = index.centres.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(index)  # as large as the sample's root, whatever the input

    def listed(n: int):
        def run(batches):
            for batch in batches:
                near = shared.value.nearest(unit(batch.column(1), width), n)
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), *[c.take(take) for c in batch.columns]], names=["list", "vec_id", "embedding"])

        return run

    schema = "list int, vec_id long, embedding array<double>"
    held, asked = stored(rows.mapInArrow(listed(1), schema)), stored(queries.mapInArrow(listed(index.probes), schema))
    parts = lambda df, c: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / how.part_rows).cast("int").alias(c))
    sizes = stored(parts(held, "rows").join(parts(asked, "asks"), "list"))
    deal = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c).cast("long")).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = held.join(sizes, "list").select("list", deal("rows").alias("r"), all_of("asks").alias("q"), "vec_id", "embedding")
    right = asked.join(sizes, "list").select("list", all_of("rows").alias("r"), deal("asks").alias("q"), "vec_id", "embedding")

    def best(own: pa.Table, ask: pa.Table) -> pa.Table:
        names = {"vec_id": pa.int64(), "neighbour_id": pa.int64(), "score": pa.float64()}
        if not own.num_rows or not ask.num_rows:
            return pa.schema(list(names.items())).empty_table()
        x, y = unit(own.column("embedding"), width), unit(ask.column("embedding"), width)
        ids, theirs = np.asarray(own.column("vec_id")), np.asarray(ask.column("vec_id"))
        out: list[list[np.ndarray]] = [[], [], []]
        for a in range(0, len(y), 512):
            s = np.round(y[a : a + 512] @ x.T, 9)
            s[theirs[a : a + 512, None] == ids] = -np.inf
            n = min(how.k, len(ids))
            floor = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            q, r = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            order = np.lexsort((ids[r], -s[q, r], q))
            q, r = q[order], r[order]
            first = np.append(0, np.flatnonzero(q[1:] != q[:-1]) + 1) if len(q) else np.zeros(0, int)
            keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < how.k
            for column, value in zip(out, (theirs[a + q[keep]], ids[r[keep]], s[q[keep], r[keep]])):
                column.append(value)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=pa.schema(list(names.items())))

    key = ["list", "r", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, "vec_id long, neighbour_id long, score double")
    order = W.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)
