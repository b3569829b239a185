"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over each document's words.

Text is lower-cased in A-Z and cut into words of letters, digits and non-ASCII characters. Each run of ``window``
words of an item is a window; an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit; each occurrence found by hash is compared word by word. A document is contaminated if
it has a hit and at least ``min_share`` of its words are hit.

The benchmark's words are counted first. Blocks of about ``block_words`` words are broadcast one after the other, and the
documents are scanned once for each, a pass being written before the next; a benchmark of the usual size is one block.

Cases: null and empty texts have no words, no hits and are clean; a very long text is scanned alone. Items without words
have no windows. An item whose item_id is null marks words but isn't listed. Items that share an id count once. Repeated
document rows are judged each on its own. An empty table gives no rows; an empty benchmark has no windows. Columns of the
documents that have the name of a result are replaced by `decontaminate`; `drop_contaminated` and `cut_contaminated` return
all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, Scratch, encode, hidden, read_table, text_chunks, window_hashes


@dataclass(frozen=True)
class Decontamination:
    window: int = 13
    #: Hit words per word from which on a document is contaminated: one in ``min_share``.
    min_share: int = 20
    #: Benchmark words, and so about windows, of a block; up to about 350 MB in the driver and in each worker
    #: if all of a block's words are distinct (270 MB of it the words themselves), far less for texts of a language.
    block_words: int = 1_500_000
    #: An item of more words is indexed in parts.
    part_words: int = 100_000


def normalised_words(text: str | None) -> list[bytes]:
    return encode(text).translate(ALNUM_TABLE).split() if text else []


class WindowIndex:
    """The windows of a block of benchmark items, by length, in arrays: about 20 bytes a window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        code = self.vocab.setdefault
        lists = [np.fromiter((code(w, len(self.vocab)) for w in words), np.int32, len(words)) for _, words in items]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.concatenate([np.zeros(0, np.int32), *lists])
        self.ends = np.cumsum(counts)
        for seed in range(100):  # a seed under which no two windows of a length have the same hash
            self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab], np.uint64)
            self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            if all(self._add(n, counts, window) for n in np.unique(np.minimum(counts, window)) if n):
                return
        raise ValueError("no hash seed separates the windows")

    def _add(self, n: int, counts: np.ndarray, window: int) -> bool:
        """Adds the windows of n words: distinct hashes, and for each the places where it starts; False if a hash has
        two windows."""
        fit = np.flatnonzero(np.minimum(counts, window) == n)
        of = np.repeat(fit, counts[fit] - n + 1)
        first = np.repeat(np.cumsum(counts[fit] - n + 1) - (counts[fit] - n + 1), counts[fit] - n + 1)
        place = (self.ends - counts)[of] + np.arange(len(of)) - first
        keys = window_hashes(self.hashes[self.ids], n)[place]
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        same = keys[1:] == keys[:-1]
        for j in range(n):
            if (self.ids[place[1:][same] + j] != self.ids[place[:-1][same] + j]).any():
                return False
        new = np.flatnonzero(np.append(True, ~same))
        self.lengths[int(n)] = (keys[new], np.append(new, len(keys)), place)
        return True

    def owners(self, n: int, k: int) -> list[int]:
        """Numbers of the items that hold window k of n words."""
        _, first, place = self.lengths[n]
        return np.unique(np.searchsorted(self.ends, place[first[k] : first[k + 1]], "right")).tolist()

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[int]]]:
        """For each text its word count, the places of its hit words, and the numbers of the items found."""
        get = self.vocab.get
        lists = [normalised_words(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(counts) - counts
        ids = np.fromiter((get(w, -1) for words in lists for w in words), np.int64, int(counts.sum()))
        doc = np.repeat(np.arange(len(lists)), counts)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        hashes = self.hashes[ids] if len(self.hashes) else np.zeros(len(ids), np.uint64)
        cover = np.zeros(len(ids) + 1, np.int64)
        items: list[set[int]] = [set() for _ in lists]
        for n, (keys, first, place) in self.lengths.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero((unknown[n:] == unknown[:-n]) & (doc[: len(ids) - n + 1] == doc[n - 1 :]))
            if not len(at):
                continue
            got = window_hashes(hashes, n)[at]
            k = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            at, k = at[keys[k] == got], k[keys[k] == got]
            same = (ids[at[:, None] + np.arange(n)] == self.ids[place[first[k]][:, None] + np.arange(n)]).all(axis=1) if len(at) else np.zeros(0, bool)
            at, k = at[same], k[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            for d, w in set(zip(doc[at].tolist(), k.tolist())):
                items[d].update(self.owners(n, w))
        hit = np.cumsum(cover[:-1]) > 0
        return [
            (int(c), np.flatnonzero(hit[s : s + c]) if hit[s : s + c].any() else np.zeros(0, np.int64), i)
            for s, c, i in zip(starts.tolist(), counts.tolist(), items)
        ]


def _spans(places: np.ndarray) -> list[dict[str, int]]:
    """Places of words as runs: start, end (exclusive)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    first, last = np.concatenate([[places[0]], places[cut + 1]]), np.concatenate([places[cut], [places[-1]]])
    return [{"start": int(a), "end": int(b) + 1} for a, b in zip(first, last)]


def cut_spans(text: str, spans: list[dict[str, int]]) -> str:
    """The text without its words at the given places; what stands between removed words goes too."""
    raw = encode(text)
    flat, ends, p = raw.translate(ALNUM_TABLE), [], 0
    for word in flat.split():
        p = flat.index(word, p)
        ends.append((p, p + len(word)))
        p += len(word)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : ends[s["start"]][0]])
        at = ends[s["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _item_words(benchmark: DataFrame, how: Decontamination) -> DataFrame:
    """i (item id as a string), words (normalised, joined by spaces) and n of the benchmark's items. An item of over
    ``part_words`` words comes in parts that share a window's words less one, so that each window is in one part."""
    step = how.part_words - how.window + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normalised_words(text)
                parts = [words[a : a + how.part_words] for a in range(0, max(1, len(words) - how.window + 1), step)] if words else []
                if parts:
                    columns = [pa.array([item] * len(parts), pa.string()), pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["i", "words", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    return items.mapInArrow(run, "i string, words binary, n long")


_FOUND = T.StructType([
    T.StructField("__n", T.LongType()),
    T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("__items", T.ArrayType(T.StringType())),
])


def _pass(docs: DataFrame, index, first: bool) -> DataFrame:
    """Adds __n, __spans, __items from one block of items, or extends them."""
    names = [c for c in docs.columns if c not in _FOUND.names]
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowIndex = index.value
        for batch in text_chunks(batches, at):
            found = windows.scan(batch.column(at).to_pylist())
            spans = [_spans(places) for _, places, _ in found]
            items = [sorted({windows.names[i] for i in own} - {None}) for _, _, own in found]
            if not first:
                old = batch.column(len(names) + 1).to_pylist()
                for k, more in enumerate(old):
                    if more:
                        both = [np.arange(s["start"], s["end"]) for s in (*spans[k], *more)]
                        spans[k] = _spans(np.unique(np.concatenate(both)))
                items = [sorted({*x, *y}) for x, y in zip(items, batch.column(len(names) + 2).to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            new = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + new, names=[*names, *_FOUND.names])

    rows = docs.select(*names, *([] if first else _FOUND.names))
    return rows.mapInArrow(run, T.StructType([*docs.select(*names).schema.fields, *_FOUND.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """Adds n_words, n_hit, hit_spans (runs of word places), hit_items (item ids as strings, sorted) and contaminated."""
    spark = docs.sparkSession
    new = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]
    out, own = hidden(docs.drop(*new), "text")
    scratch = Scratch(spark, "decontaminate")
    items = scratch.write("items", _item_words(benchmark, how))
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // how.block_words))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("i", "words"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(WindowIndex([(r.i, r.words.split()) for r in mine.select("i", "words").collect()], how.window))
        out = _pass(out, index, first=k == 0)
        if k + 1 < blocks:
            out = scratch.write(f"pass{k}", out)
            if k:
                scratch.drop(f"pass{k - 1}")
    scratch.drop("items")
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    out = out.withColumn("__hit", n_hit)
    bad = (F.col("__hit") > 0) & (F.col("__hit") * how.min_share >= F.col("__n"))
    found = [F.col("__n"), F.col("__hit"), F.col("__spans"), F.col("__items"), bad]
    return out.select(*own, *[c.alias(name) for c, name in zip(found, new)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """The documents, with their own columns, that aren't contaminated."""
    inner, own = hidden(docs, "text")
    return decontaminate(inner, benchmark, how).where(~F.col("contaminated")).select(*own)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """All documents, with their own columns; contaminated ones lose their hit spans."""
    inner, own = hidden(docs, "text")
    found = decontaminate(inner, benchmark, how)

    @F.pandas_udf("string")
    def cut(text, spans, bad):
        return text.where(~bad, [cut_spans(t, list(s)) if b else t for t, s, b in zip(text, spans, bad)])

    return found.withColumn("text", cut("text", "hit_spans", "contaminated")).select(*own)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS i, coalesce({_WORDS_SQL}, []) AS ws FROM benchmark),
bw AS (SELECT DISTINCT i, n, array_to_string(ws[p : p + n - 1], ' ') AS s
       FROM (SELECT i, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, n, p, array_to_string(ws[p : p + n - 1], ' ') AS s
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT r, n, p, i FROM dw JOIN bw USING (n, s)),
c AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS w FROM h) GROUP BY r),
a AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, i FROM h WHERE i IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN a USING (r)"""
