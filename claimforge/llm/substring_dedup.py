"""Substring deduplication by seed and extend over winnowed anchors.

A window is ``window`` consecutive words (cut at ASCII white space, unchanged) of one document. Every word is removed
that lies in a window whose words also start earlier: in a document of less doc_id, or earlier in the same document.
So the first copy of a passage stays, and of each maximal repeat of at least ``window`` words all later copies go.

Seeds: of the ``seed``-word runs in a window the one of the least hash (the leftmost of equals) is the window's anchor.
It depends on the window's words alone, so equal windows have equal anchors, and the windows around one anchor are a run
of neighbours. Documents are joined on anchors; only an anchor's hash, its place and the hash of its reach travel, where
the reach is all that its windows cover, extended to both sides as far as the anchor is theirs.

Extension: places of an anchor with the same reach match over all of it, to both sides, so all but the first are marked
whole. First places of different reaches of one anchor match over a part only: they go back to their texts and are
extended window by window, each window being a number of words to the left of the anchor and the rest to its right; of
equal ones all but the first are marked. Marks that touch are one maximal repeat. Reaches and windows are equal if the
128-bit BLAKE2 digests of their words are; the 64-bit hash of an anchor only brings places together.

Hot anchors: of the places in one batch of texts with the same anchor and reach one travels, and the others are marked at
once. Where a batch holds ``spread`` reaches of an anchor, its windows are extended at once and travel by window, of equal
ones only the first. So an anchor that a third of all documents holds sends a few rows for each batch to its task.

Cases: null, empty and short texts have no windows and stay whole; a very long text is one batch of its own. Rows with a
null doc_id stay whole and are no source. Rows that share a doc_id don't remove each other's words at the same places; a
removal at a place holds for all of them. Repeated rows are such rows. An empty table gives no rows. Columns of the
documents that have the name of a result (n_words, n_removed, kept_text) are replaced; all others come through as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut_words, encode, hidden, mix, read_table, segment_hashes, text_chunks, window_hashes


@dataclass(frozen=True)
class SubstringDedup:
    window: int = 20
    seed: int = 6
    #: So many reaches of one anchor in a batch of texts are extended at once.
    spread: int = 4
    #: Text bytes of a batch.
    batch_bytes: int = 8_000_000


SIGNAL, REACH, WINDOW, MARK = range(4)
_FOUND = "key long, kind byte, same long, same2 long, doc long, pos int, n int"
_PLACE = ["key", "kind", "same", "same2", "doc", "pos", "n"]


class Texts:
    """The words of several texts in a row: their hashes, and digests of runs of them."""

    def __init__(self, texts: list[str | None]):
        raw, first, size, self.starts, self.counts = cut_words(texts)
        self.words = segment_hashes(raw, first, size)
        # The words again, one space after each.
        kept = np.zeros(len(raw), bool)
        kept[runs(first, size)] = True
        kept[first + size] = True
        self.ends = np.cumsum(size + 1) - 1
        self.first = self.ends - size
        plain = raw[kept]
        plain[self.ends] = 32
        self.plain = memoryview(plain)

    def digests(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digest of n words from the word ``first`` on, for each pair of them."""
        text = self.plain
        found = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(self.first[first].tolist(), self.ends[first + n - 1].tolist())])
        halves = np.frombuffer(found, np.uint64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n places each, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def anchored_runs(texts: Texts, how: SubstringDedup):
    """The runs of windows with one anchor: the anchor's hash, the document's number, the place of the first window, and
    the number of windows."""
    n, k, words, starts, counts = how.window, how.seed, texts.words, texts.starts, texts.counts
    if len(words) < n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    seeds = window_hashes(words, k)
    doc = np.repeat(np.arange(len(counts)), counts)
    span = np.lib.stride_tricks.sliding_window_view(seeds, n - k + 1)
    anchor = np.arange(len(span)) + np.concatenate([span[a : a + 65_536].argmin(axis=1) for a in range(0, len(span), 65_536)])
    inside = doc[: len(span)] == doc[n - 1 :]
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1 : len(span)] == doc[: len(span) - 1]))
    run = np.flatnonzero(first)
    size = np.diff(np.append(np.searchsorted(np.flatnonzero(inside), run), np.count_nonzero(inside)))
    return seeds[anchor[run]], doc[run], run - starts[doc[run]], size


def _later(*keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys, doc and pos; in it, which rows lead the rows of equal keys, and which stand at a later place
    than their leader."""
    order = np.lexsort((pos, doc, *reversed(keys)))
    lead = np.ones(len(order), bool)
    lead[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
    d, p = doc[order], pos[order]
    return order, lead, (d != d[at]) | (p != p[at])


def _rows(key, kind: int, same, same2, doc, pos, n) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int8)), pa.array(same.view(np.int64)), pa.array(same2.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=_PLACE)


def _marks(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Marks travel by their place, so that those of one anchor don't meet."""
    none = np.zeros(len(doc), np.uint64)
    return _rows(mix(doc.view(np.uint64) + mix(pos.astype(np.uint64))), MARK, none, none, doc, pos, n)


def window_key(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    return mix(anchor + mix(window))


def _seeds(rows: DataFrame, how: SubstringDedup) -> DataFrame:
    """The rows of a batch that travel: reaches (key: anchor, same: reach), windows (key: anchor and window, same:
    window) of spread anchors with a signal for each such anchor, and marks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=how.batch_bytes):
            texts = Texts(batch.column(1).to_pylist())
            h, number, pos, size = anchored_runs(texts, how)
            if not len(h):
                continue
            doc, at = np.asarray(batch.column(0))[number], texts.starts[number] + pos
            reach, reach2 = texts.digests(at, size + how.window - 1)
            order, lead, later = _later(h, reach, reach2, doc=doc, pos=pos)
            gone = order[later]
            yield _marks(doc[gone], pos[gone], size[gone])
            kept = order[lead]
            _, group, many = np.unique(h[kept], return_inverse=True, return_counts=True)
            wide = many[group] >= how.spread
            own = kept[~wide]
            yield _rows(h[own], REACH, reach[own], reach2[own], doc[own], pos[own], size[own])
            own = kept[wide]
            if not len(own):
                continue
            anchors = np.unique(h[own])
            none = np.zeros(len(anchors), np.int64)
            yield _rows(anchors, SIGNAL, none, none, none, none, none)
            d, p, word = np.repeat(doc[own], size[own]), runs(pos[own], size[own]), runs(at[own], size[own])
            w, w2 = texts.digests(word, np.full(len(word), how.window))
            key = window_key(np.repeat(h[own], size[own]), w)
            order, lead, later = _later(key, w, w2, doc=d, pos=p)
            gone, first = order[later], order[lead]
            yield _marks(d[gone], p[gone], np.ones(len(gone), np.int32))
            yield _rows(key[first], WINDOW, w[first], w2[first], d[first], p[first], np.ones(len(first), np.int32))

    return rows.mapInArrow(run, _FOUND)


def _matched(seeds: DataFrame) -> DataFrame:
    """Joins the places by anchor. Of each reach, and of each window, the places after the first become marks; first
    places go on where an anchor has several reaches. Memory holds a batch and two rows, whatever the size of a group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None  # a signal if the last key has several reaches, and the last leader
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind, same, same2, doc, pos, n = (np.asarray(batch.column(i)) for i in range(7))
            done = np.zeros(len(key), bool)
            if kept is not None:
                key, kind, same, same2, doc, pos, n, done = (np.concatenate(x) for x in zip(kept, (key, kind, same, same2, doc, pos, n, done)))
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, (kind[1:] != kind[:-1]) | (same[1:] != same[:-1]) | (same2[1:] != same2[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            placed = (kind == REACH) | (kind == WINDOW)
            later = placed & ((doc != doc[at]) | (pos != pos[at])) | (kind == MARK)
            group = np.cumsum(new_key) - 1
            several = (np.bincount(group, new & (kind == REACH)) >= 2) | (np.bincount(group, kind == SIGNAL) > 0)
            first = new & ~done & ((kind == WINDOW) | (kind == REACH) & several[group])
            out = np.flatnonzero(later | first)
            what = np.where(later, MARK, kind)[out].astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[out], what, same[out], same2[out], doc[out], pos[out], n[out])], names=_PLACE)
            last = at[-1:] if placed[-1] else at[:0]
            kept = [np.concatenate([x[-1:] if several[-1] else x[:0], x[last]]) for x in (key, kind, same, same2, doc, pos, n, done)]
            if several[-1]:
                kept[1][0] = SIGNAL
            kept[7][:] = True if several[-1] or (len(last) and kind[last[0]] == WINDOW) else False

    met = seeds.repartition("key").sortWithinPartitions("key", "kind", "same", "same2", "doc", "pos")
    return met.mapInArrow(run, _FOUND)


def _extended(rows: DataFrame, found: DataFrame, how: SubstringDedup) -> DataFrame:
    """key, same, same2, doc, pos of the single windows of first places whose anchors have several reaches."""
    wanted = found.where(F.col("kind") == REACH).groupBy(F.col("doc").alias("__id")).agg(F.collect_list(F.struct("key", "pos", "n")).alias("__at"))
    # The same join at every size: texts meet their places by a shuffle, and a task holds the places of its part.
    joined = rows.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("__id")).select("id", "text", "__at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts, at = Texts(batch.column(1).to_pylist()), batch.column(2)
            number = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths()))
            anchor, pos, n = (np.asarray(x) for x in at.flatten().flatten())
            # Another text of the same doc_id may end before the place.
            fits = pos + n + how.window - 1 <= texts.counts[number]
            number, anchor, pos, n = number[fits], anchor[fits].view(np.uint64), pos[fits].astype(np.int64), n[fits].astype(np.int64)
            place, number = runs(pos, n), np.repeat(number, n)
            w, w2 = texts.digests(texts.starts[number] + place, np.full(len(place), how.window))
            key, doc = window_key(np.repeat(anchor, n), w), np.asarray(batch.column(0))[number]
            columns = [pa.array(key.view(np.int64)), pa.array(w.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=_WINDOW)

    return joined.mapInArrow(run, "key long, same long, same2 long, doc long, pos int")


_WINDOW = ["key", "same", "same2", "doc", "pos"]


def _marked(docs: DataFrame, how: SubstringDedup) -> DataFrame:
    """doc and marks (place and number of the windows) of the documents that have some, in a written table."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = scratch.write("matched", _matched(_seeds(rows, how)))
    single = scratch.write("single", _extended(rows, found, how).union(found.where(F.col("kind") == WINDOW).select(*_WINDOW)))
    # The first place by a minimum, which combines before the shuffle; a join of two plain exchanges can be split.
    least = scratch.write("least", single.groupBy("key", "same", "same2").agg(F.min(F.struct("doc", "pos")).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    later = single.join(least, ["key", "same", "same2"]).where("doc <> lead.doc OR pos <> lead.pos").select("doc", "pos", F.lit(1).alias("n"))
    marks = found.where(F.col("kind") == MARK).select("doc", "pos", "n").union(later)
    return scratch.only("marks", marks.groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("marks")))


def _spans(marks: pa.Array, how: SubstringDedup) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 places of the words that marks cover, touching ones in one."""
    first, n = (np.asarray(x).astype(np.int64) for x in marks.flatten())
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate((first + n + how.window - 1)[order])
    cut = np.flatnonzero(first[1:] > last[:-1]) + 1
    return first[np.append(0, cut)], last[np.append(cut - 1, len(last) - 1)]


def repeated_spans(docs: DataFrame, how: SubstringDedup = SubstringDedup()) -> DataFrame:
    """doc_id and spans, the runs of word places (start, end exclusive) that are repeats, of documents that have some."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b} for a, b in zip(*_spans(x.values, how))] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return _marked(docs, how).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, how: SubstringDedup = SubstringDedup()) -> DataFrame:
    """Adds n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    new = ["n_words", "n_removed", "kept_text"]
    docs, own = hidden(docs.drop(*new), "doc_id", "text")
    names = docs.columns
    found = _marked(docs.select("doc_id", "text"), how).toDF("__id", "__marks")
    # The same join at every size, by a shuffle; rows without a doc_id, which have no marks, don't go to one task.
    joined = docs.where("doc_id IS NOT NULL").join(found.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left").select(*names, "__marks")
    joined = joined.union(docs.where("doc_id IS NULL").withColumn("__marks", F.lit(None).cast(found.schema["__marks"].dataType)))
    at, last = names.index("text"), len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, at):
            counts, gone, kept = [], [], []
            for text, marks in zip(batch.column(at).to_pylist(), batch.column(last)):
                words = encode(text).split() if text else []
                counts.append(len(words))
                if marks.is_valid:
                    for a, b in zip(*map(np.flip, _spans(marks.values, how))):
                        del words[a:b]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            columns = [batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[*names, *new],
            )

    kinds = [T.StructField(name, kind) for name, kind in zip(new, (T.LongType(), T.LongType(), T.StringType()))]
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *kinds])).select(*own, *new)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 19], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20)),
m AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM m),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
