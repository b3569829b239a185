"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each document has `FEATURES`, numbers of its own text. They are standardised over the labelled rows, and mapped by
random Fourier features, whose inner products approximate a Gaussian kernel. Ridge weights come from normal equations
that each partition sums for its rows and that are summed again before the driver sees them, so the driver holds a few
matrices of a fixed size whatever the input. For calibration each labelled row is scored by weights of the other fold
only, which the same sums give; those scores are counted in a fixed number of bins, and pooled until they don't fall: that
isotonic step function maps raw scores to probabilities. Documents are then scored by the weights of all labelled rows.

Learned from: all labelled rows that aren't held out (crc32 of the doc_id as text, modulo 4, is not 2). Labels, lang,
source and doc_id are no inputs of a score.

Cases: null and empty texts have all counts 0 and are scored like any other; a very long text is read alone. Null labels
and labels without a document are left out; several labels of a document all count. Without labelled rows each score is
0.5. A null doc_id counts as held out. Repeated rows are scored each on its own. An empty table gives no rows. Other columns
of the documents, whatever their names, aren't read and don't come out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, encode, held_out, read_table, text_chunks

FEATURES = (
    "log_words", "log_chars", "log_lines", "word_length", "long_words", "space_share", "digit_share", "upper_share",
    "symbol_share", "exclaim_share", "bar_share", "comma_share", "stop_share", "other_ascii_share", "high_share",
    "upper_words", "marked_words", "distinct_words", "top_word", "repeat_triples", "distinct_lines", "closed_lines",
    "mean_line", "mean_sentence", "bigram_entropy",
)


@dataclass(frozen=True)
class QualityModel:
    dimensions: int = 256
    bandwidth: float = 4.0
    ridge: float = 1e-3
    clip: float = 6.0
    bins: int = 2000
    seed: int = 7
    #: Score from which on a document counts as good.
    threshold: float = 0.7


_BYTES = np.zeros((256, 10))
for _i, _set in enumerate((b" \t\n\r\x0b\x0c", b"0123456789", bytes(range(65, 91)), b"#*$%&<>", b"!", b"|", b",", b".?;:", b"\"'()-_/@=+[]{}~^`\\")):
    _BYTES[list(_set), _i] = 1
_BYTES[128:, 9] = 1
_marked = re.compile(rb"[#*$%&|<>!@=]").search


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one text; all are defined for an empty one."""
    raw = encode(text) if text else b""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    space, digit, upper, symbol, shout, bar, comma, stop, other, high = (counts @ _BYTES) / n
    words = raw.split()
    m = max(1, len(words))
    kinds = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    pairs = np.array(sorted(kinds.values()), float) / m
    return [
        math.log1p(len(words)), math.log1p(len(raw)), math.log1p(len(lines)), (n - space * n) / m,
        sum(len(w) > 12 for w in words) / m, space, digit, upper, symbol, shout, bar, comma, stop, other, high,
        sum(w.isupper() for w in words) / m, sum(_marked(w) is not None for w in words) / m, len(kinds) / m,
        max(kinds.values(), default=0) / m, sum(c for c in triples.values() if c > 1) / m, len(set(lines)) / k,
        sum(x.rstrip().endswith((b".", b"?", b"!", b":")) for x in lines) / k, math.log1p(n / k),
        math.log1p(m / max(1.0, stop * n)), float(-(pairs * np.log(pairs)).sum()) if words else 0.0,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row, as one array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            values = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Mapping:
    """Standardised statistics -> random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, how: QualityModel):
        draw = np.random.default_rng(how.seed)
        self.mean, self.std, self.clip = mean, np.where(std > 1e-12, std, 1.0), how.clip
        self.directions = draw.normal(0, 1 / how.bandwidth, (len(mean), how.dimensions))
        self.phases = draw.uniform(0, 2 * np.pi, how.dimensions)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -self.clip, self.clip)
        features = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([features, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


#: Rows are fitted and calibrated in so many folds, by a hash of their doc_id.
FOLDS = 2
#: Sums that one task adds up, and that the driver gets at most.
FAN_IN = 16


def _summed(rows: DataFrame, mapping: Mapping, how: QualityModel) -> np.ndarray:
    """For each fold the sum over its rows fold, x, y of outer products of (features, y) with themselves. Each partition
    sums its rows, and the sums are summed in a tree, so no task and no driver meets many of them."""
    size = how.dimensions + 2

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            if batch.num_rows:
                z, fold = np.hstack([mapping(_matrix(batch.column(1))), np.asarray(batch.column(2)).reshape(-1, 1)]), np.asarray(batch.column(0))
                for k in range(FOLDS):
                    total[k] += z[fold == k].T @ z[fold == k]
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw).reshape(total.shape)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    n, sums = rows.rdd.getNumPartitions(), rows.mapInArrow(part, "s binary")
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        sums = sums.repartition(n).mapInArrow(join, "s binary")
    return sum((np.frombuffer(r.s).reshape(FOLDS, size, size) for r in sums.toLocalIterator()), np.zeros((FOLDS, size, size)))


def _weights(total: np.ndarray, how: QualityModel) -> np.ndarray:
    gram, right, n = total[:-1, :-1], total[:-1, -1], total[-2, -2]
    return np.linalg.solve(gram + (how.ridge * n + 1e-9) * np.eye(len(gram)), right)


def pool(counts: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: for each bin the share of good rows, made not to fall from bin to bin."""
    blocks: list[list[float]] = []
    for n, g in zip(counts, good):
        blocks.append([float(n), float(g), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0] and (blocks[-1][0] or blocks[-2][0]):
            n2, g2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + g2, blocks[-1][2] + k2]
    out, last = [], 0.5
    for n, g, k in blocks:
        last = g / n if n else last
        out += [last] * int(k)
    return np.array(out)


class Scorer:
    """Scores statistics; made by `fit`."""

    LOW, HIGH = -0.5, 1.5

    def __init__(self, mapping: Mapping | None, weights: np.ndarray | None, bins: int):
        self.mapping, self.weights, self.bins = mapping, weights, bins
        self.levels: np.ndarray | None = None

    def bin(self, x: np.ndarray) -> np.ndarray:
        raw = self.mapping(x) @ self.weights
        return np.clip((raw - self.LOW) / (self.HIGH - self.LOW) * self.bins, 0, self.bins - 1).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.levels is None else self.levels[self.bin(x)]


def fit(stats: DataFrame, labels: DataFrame, how: QualityModel = QualityModel()) -> Scorer:
    """A scorer from doc_id, x and the labels doc_id, quality of rows that aren't held out."""
    scratch = Scratch(stats.sparkSession, "quality")
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("__id"), (F.col("quality") > 0).cast("double").alias("y"))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("__id")).select(fold, "x", "y")
    rows = scratch.write("labelled", rows)
    moments = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    if not moments:
        return Scorer(None, None, how.bins)
    mapping = Mapping(np.array([r.m for r in moments]), np.array([r.s for r in moments]), how)
    total = _summed(rows, mapping, how)
    others = [Scorer(mapping, _weights(total.sum(axis=0) - own, how), how.bins) for own in total]

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, fold = _matrix(batch.column(1)), np.asarray(batch.column(0))
                found = np.select([fold == k for k in range(FOLDS)], [s.bin(x) for s in others])
                yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(2)], names=["b", "y"])

    counts, good = np.zeros(how.bins), np.zeros(how.bins)
    for r in rows.mapInArrow(bins, "b long, y double").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("g")).collect():
        counts[r.b], good[r.b] = r.n, r.g
    scorer = Scorer(mapping, _weights(total.sum(axis=0), how), how.bins)
    scorer.levels = np.clip(pool(counts, good), 0.0, 1.0)
    scratch.drop("labelled")
    return scorer


def score_quality(docs: DataFrame, labels: DataFrame, how: QualityModel = QualityModel()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of doc_id, text."""
    stats = Scratch(docs.sparkSession, "quality").write("statistics", document_statistics(docs))
    scorer = fit(stats, labels, how)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(_matrix(batch.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    predicted = (F.col("score") >= how.threshold).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
