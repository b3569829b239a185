"""Which of many strings occur in a text.

Up to ``BLOCK_CHARS`` characters of strings are sent to the tasks as one Aho-Corasick automaton. More of them stay where they
are: a text is read once, whatever their number, by windows of a few widths, each window is looked up among the first
characters of the strings, and what a hit may hold is joined with the strings themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import sieved
from .lineage import stored

#: Characters of strings up to which they are sent to the tasks: an automaton takes about 50 bytes for each.
BLOCK_CHARS = 1_000_000
#: Widths of windows: a string is looked up by its first characters, as many as the largest width that it has. A text is cut
#: into pieces first, since a place in a string is found by counting from its start.
WIDTHS, PIECE = (1, 2, 4, 8, 16, 32), 256
#: Distinct beginnings up to which their table is sent to the tasks; more are joined by a shuffle of the windows
#: that pass a sieve.
HEADS = 50_000

#: Bytes of texts that a task scans at once, but for what the last of them goes beyond.
SCAN_BYTES = 4_000_000

_held: dict[str, tuple[ahocorasick.Automaton, np.ndarray, pa.Array]] = {}


def _automaton(key: str, heads: list[tuple[str, list[int]]]) -> tuple[ahocorasick.Automaton, np.ndarray, pa.Array]:
    """A worker holds the automaton of the block that it served last, with the lengths of its strings and themselves."""
    if key not in _held:
        _held.clear()
        built = ahocorasick.Automaton()
        for k, (w, _) in enumerate(heads):
            built.add_word(w, k)
        built.make_automaton()
        _held[key] = built, np.array([len(w) for w, _ in heads]), pa.array([w for w, _ in heads], pa.string())
    return _held[key]


def _row(texts: pa.Array) -> tuple[str, np.ndarray]:
    """All texts in a row, and where each begins and the last one ends."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    raw = raw.to_pybytes()[at[0] : at[-1]] if raw is not None else b""
    row, at = raw.decode(), at - at[0]
    if len(row) < len(raw):
        at = np.cumsum([0, *((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[at]
    return row, at


def _found(key: str, heads: list[tuple[str, list[int]]], texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The numbers of texts, ascending, and the distinct strings found in each: those that begin with a head and have one of
    its sizes."""
    automaton, length, words = _automaton(key, heads)
    # One pass over all texts in a row: what reaches beyond its own text is left out.
    joined, start = _row(texts)
    hits = np.array(list(automaton.iter(joined)) if joined else [], np.int64).reshape(-1, 2)
    first, stop, head = hits[:, 0] + 1 - length[hits[:, 1]], hits[:, 0] + 1, hits[:, 1]
    row = np.searchsorted(start, first, "right") - 1
    inside = stop <= start[row + 1]
    row, first, head = row[inside], first[inside], head[inside]
    if all(sizes == [len(w)] for w, sizes in heads):
        own = np.unique(row * len(heads) + head)
        return own // len(heads), words.take(pa.array(own % len(heads)))
    at = zip(row.tolist(), first.tolist(), head.tolist(), start[row + 1].tolist())
    some = sorted({(r, joined[f : f + n]) for r, f, h, end in at for n in heads[h][1] if f + n <= end})
    return np.array([r for r, _ in some], np.int64), pa.array([w for _, w in some], pa.string())


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SCAN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return zip(cuts, cuts[1:])


def _scan(texts: DataFrame, at: int, heads: list[tuple[str, list[int]]], schema: T.StructType) -> DataFrame:
    together = isinstance(schema.fields[-1].dataType, T.ArrayType)
    shared, key = texts.sparkSession.sparkContext.broadcast(heads), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(batch.column(at)):
                rows, found = _found(key, shared.value, batch.column(at).slice(a, b - a))
                if together:
                    rows, firsts = np.unique(rows, return_index=True)
                    found = pa.ListArray.from_arrays(pa.array([*firsts.tolist(), len(found)] if len(rows) else [0], pa.int32()), found)
                part = batch.slice(a, b - a).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=schema.names)

    return texts.mapInArrow(run, schema)


def _by_windows(texts: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """The same for any number of words, by joins."""
    size = F.length("part")
    width = F.greatest(*[F.when(size >= w, F.lit(w)).otherwise(0) for w in WIDTHS])
    least = {r.w: r.n for r in words.groupBy(width.alias("w")).agg(F.min(size).alias("n")).collect()}
    heads = stored(words.groupBy(F.substr("part", F.lit(1), width).alias("__head")).agg(F.collect_set(size).alias("__sizes")))
    n = heads.count()
    rows = texts.select("*", F.length(column).alias("__len"))
    rows = rows.where("__len > 0").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__len") - 1) / PIECE).cast("int"))).alias("__k"))
    rows = rows.withColumn("__piece", F.substr(column, F.col("__k") * PIECE + 1, F.lit(PIECE + WIDTHS[-1])))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("__piece")))).alias("__at"))
    rows = rows.withColumn("__left", F.col("__len") - F.col("__k") * PIECE - F.col("__at") + 1)
    # A window is of no use where the text has no room for the shortest string of its width.
    room = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in sorted(least.items())]), lambda x: x["n"] <= F.col("__left"))
    rows = rows.select("*", F.explode(room).alias("__w")).withColumn("__head", F.substr("__piece", F.col("__at"), F.col("__w.w")))
    if n <= HEADS:
        heads = F.broadcast(heads)
    else:
        # Windows that are no beginning are dropped before they are shuffled, but for a few.
        rows = sieved(rows, "__head", heads.select(F.col("__head").alias("id")), n)
    met = rows.join(heads, "__head").select(*texts.columns, (F.col("__k") * PIECE + F.col("__at")).alias("__at"), "__left", F.explode("__sizes").alias("__n"))
    met = met.where("__n <= __left").withColumn("part", F.substr(column, F.col("__at"), F.col("__n")))
    # The first of the places where a text holds a string stands for all of them.
    return met.where(F.position("part", column) == F.col("__at")).join(words, "part").select(*texts.columns, "part")


def contained(texts: DataFrame, column: str, parts: DataFrame, together: bool = False) -> DataFrame:
    """The rows of ``texts`` with each distinct part (column part) that occurs in their ``column``. Null texts hold none;
    null and empty parts occur nowhere. With ``together`` a row has all of its parts, at least one, as an array (parts), and
    equal rows may become one."""
    own = T.StructField("parts", T.ArrayType(T.StringType())) if together else T.StructField("part", T.StringType())
    schema = T.StructType([*texts.schema.fields, own])
    words = stored(parts.select("part").where("part <> ''").distinct())
    n = words.agg(F.sum(F.length("part"))).first()[0]
    if n is None:
        return texts.sparkSession.createDataFrame([], schema)
    if n > BLOCK_CHARS:
        rows = _by_windows(texts, column, words)
        return rows.groupBy(*texts.columns).agg(F.collect_list("part").alias("parts")) if together else rows
    return _scan(texts, texts.columns.index(column), [(r.part, [len(r.part)]) for r in words.collect()], schema)


#: Characters of a string that stand for it where all of them together are too many.
STUBS = (32, 16, 8, 6, 4, 3, 2, 1)


def maybe_contained(texts: DataFrame, column: str, parts: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``column`` holds some part (column part), with all that it holds, as an array (parts). More
    parts than one automaton takes are looked up by as many of their first characters as it does; then the array may
    also have strings that only begin like a part and are as long as one, and there may be rows that have no others. Texts
    are read once, and in the task, whatever the number of parts."""
    schema = T.StructType([*texts.schema.fields, T.StructField("parts", T.ArrayType(T.StringType()))])
    words = stored(parts.select("part").where("part <> ''").distinct())
    size = F.length("part")
    most = words.agg(F.max(size)).first()[0]
    if most is None:
        return texts.sparkSession.createDataFrame([], schema)
    for width in (most, *(w for w in STUBS if w < most)):
        heads = words.groupBy(F.substr("part", F.lit(1), F.lit(width)).alias("head")).agg(F.collect_set(size).alias("sizes"))
        if width == 1 or heads.agg(F.sum(F.length("head"))).first()[0] <= BLOCK_CHARS:
            break
    return _scan(texts, texts.columns.index(column), [(r.head, sorted(r.sizes)) for r in heads.collect()], schema)
