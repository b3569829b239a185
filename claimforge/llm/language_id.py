"""Language identification by a linear-chain conditional random field over words.

Each word has emission weights from affix, character n-gram and lexicon features; transitions between the languages of
neighbouring words are learned too. Forward-backward gives each word of a text its probabilities, so a text that switches
languages is labelled word by word (`label_words`); the text's language is the one with most probability over its words, and its score
that share.

Training: a bounded sample of at most about ``docs_per_language`` documents of each language (chosen by hash, never
held out), and from each at most ``segments`` runs of ``segment_words`` words spread over its whole text. Runs of
different documents are strung together, which makes text that switches. Weights are fitted by full-batch gradient
steps on the exact likelihood. All texts are labelled over all their words: blocks of words are reduced to transfer
matrices, a scan over a text's blocks links them, and the words inside are then done for all blocks at once.

Cases: a null text and a text without a letter get ``und`` and score 0. Rows with a null lang or doc_id aren't learned
from. Without training rows all is ``und``. Repeated rows are labelled each on its own; an empty table gives none. lang,
source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, held_out, read_table, text_chunks, worker_memo

_words = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"
#: Words of more letters stay out of the memo.
LONG_WORD = 100


@dataclass(frozen=True)
class LanguageModel:
    docs_per_language: int = 400
    segments: int = 6
    segment_words: int = 20
    runs_in_sequence: int = 3
    lexicon_words: int = 150
    hash_bits: int = 15
    steps: int = 40
    rate: float = 0.15
    decay: float = 1e-4
    block: int = 32
    seed: int = 11


def language_words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case; signs that count as numbers only, such as ½, are no word."""
    words = _words(text.lower()) if text else []
    return words if not text or text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def _features(word: str, lexicon: frozenset[str], bits: int) -> Iterator[int]:
    edged = f"<{word}>"
    names = [f"L{word}"] if word in lexicon else []
    names += [f"P{word[:k]}" for k in (1, 2, 3) if len(word) >= k] + [f"S{word[-k:]}" for k in (1, 2, 3) if len(word) >= k]
    grams = (edged[i : i + k] for k in (2, 3) for i in range(len(edged) - k + 1))
    return (zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for x in chain(names, grams))


def word_features(word: str, lexicon: frozenset[str], bits: int) -> list[int]:
    """Hashed features of a whole word: the word if it is in the lexicon, affixes, and character pairs and triples."""
    return list(_features(word, lexicon, bits))


def long_emission(word: str, lexicon: frozenset[str], weights: np.ndarray, bits: int) -> np.ndarray:
    """The emission scores of a word of any length, summed up part by part."""
    features, total = _features(word, lexicon, bits), np.zeros(weights.shape[1])
    while part := list(islice(features, 1 << 16)):
        total += weights[part].sum(axis=0)
    return total


def emissions(words: list[str], lexicon: frozenset[str], weights: np.ndarray, bits: int) -> np.ndarray:
    lists = [word_features(w, lexicon, bits) for w in words]
    if not lists:
        return np.zeros((0, weights.shape[1]))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    return np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)


def posteriors(scores: np.ndarray, transitions: np.ndarray, counts: np.ndarray, block: int) -> np.ndarray:
    """Label probabilities of each word of texts in a row, by forward-backward; no text is empty.

    Probabilities are rescaled at each step, so long texts neither under- nor overflow.
    """
    n, labels = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    starts = np.cumsum(counts) - counts
    blocks = -(-counts // block)
    first = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    text = np.repeat(np.arange(len(counts)), blocks)
    offset = starts[text] + (np.arange(nb) - first[text]) * block
    length = np.minimum(block, starts[text] + counts[text] - offset)
    head = np.arange(nb) == first[text]
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    e_at = lambda t, on: e[offset[on] + t]

    # Transfer matrix of each block: from the label before it to the label of its last word.
    m = np.repeat(np.eye(labels)[None], nb, axis=0)
    for t in range(block):
        on = np.flatnonzero(length > t)
        if not len(on):
            break
        step = m[on] @ a
        if t == 0:
            step[head[on]] = m[on][head[on]]
        step *= e_at(t, on)[:, None, :]
        m[on] = step / step.max(axis=(1, 2), keepdims=True)
    # Along the blocks of each text: what comes in from the left, and from the right.
    left, right = np.full((nb, labels), 1.0 / labels), np.ones((nb, labels)) / labels
    for k in range(1, int(blocks.max())):
        on = first[blocks > k] + k
        left[on] = normal((left[on - 1][:, None, :] @ m[on - 1])[:, 0])
    for k in range(int(blocks.max()) - 2, -1, -1):
        on = first[blocks > k + 1] + k
        right[on] = normal((m[on + 1] @ right[on + 1][:, :, None])[:, :, 0])
    # Inside the blocks.
    alpha = np.empty((n, labels))
    now = left.copy()
    for t in range(block):
        on = np.flatnonzero(length > t)
        if not len(on):
            break
        moved = now[on] @ a
        if t == 0:
            moved[head[on]] = now[on][head[on]]
        now[on] = normal(moved * e_at(t, on))
        alpha[offset[on] + t] = now[on]
    out = alpha
    beta = right.copy()
    # ``right`` is the message at a block's last word: it holds the step into the next block.
    for t in range(block - 1, -1, -1):
        on = np.flatnonzero(length > t)
        at = offset[on] + t
        out[at] = normal(alpha[at] * beta[on])
        beta[on] = normal((e[at] * beta[on]) @ a.T)
    return out


class Tagger(dict):
    """word -> row of its emission scores, but for very long words; emptied when it grows large."""

    def __init__(self, labels: list[str], lexicon: frozenset[str], weights: np.ndarray, transitions: np.ndarray, how: LanguageModel):
        self.labels, self.lexicon, self.weights, self.transitions, self.how = labels, lexicon, weights, transitions, how
        self.scores = np.zeros((0, len(labels)))

    def rows(self, lists: list[list[str]]) -> np.ndarray:
        """The emission scores of all words in a row."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.scores = self.scores[:0]
        some = set().union(*lists)
        new = [w for w in some if len(w) <= LONG_WORD and w not in self]
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.scores = np.concatenate([self.scores, emissions(new, self.lexicon, self.weights, self.how.hash_bits)])
        if all(len(w) <= LONG_WORD for w in some):
            return self.scores[np.fromiter((self[w] for x in lists for w in x), np.int64, sum(map(len, lists)))]
        found = {w: long_emission(w, self.lexicon, self.weights, self.how.hash_bits) for w in some if len(w) > LONG_WORD}
        return np.array([found[w] if w in found else self.scores[self[w]] for x in lists for w in x])

    def words(self, lists: list[list[str]]) -> list[np.ndarray]:
        """For each text the label probabilities of its words."""
        some = [x for x in lists if x]
        if not some:
            return [np.zeros((0, len(self.labels))) for _ in lists]
        counts = np.fromiter(map(len, some), np.int64, len(some))
        parts = iter(np.split(posteriors(self.rows(some), self.transitions, counts, self.how.block), np.cumsum(counts)[:-1]))
        return [next(parts) if x else np.zeros((0, len(self.labels))) for x in lists]

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for p in self.words([language_words(t) for t in texts]):
            share = p.mean(axis=0) if len(p) else None
            names.append(UNKNOWN if share is None else self.labels[int(share.argmax())])
            scores.append(0.0 if share is None else float(min(1.0, share.max())))
        return names, scores


def training_segments(docs: DataFrame, how: LanguageModel) -> DataFrame:
    """lang and words of runs from the sample of doc_id, text, lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(how.docs_per_language / r["n"])).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            langs, runs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = language_words(text)
                k = max(1, min(how.segments, len(words) // how.segment_words))
                for i in range(k if words else 0):
                    a = i * len(words) // k
                    langs.append(lang)
                    runs.append(words[a : a + how.segment_words])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.string()))], names=["lang", "words"])

    return chosen.mapInArrow(run, "lang string, words array<string>")


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_tagger(segments: list[tuple[str, list[str]]], how: LanguageModel = LanguageModel()) -> Tagger | None:
    """Fits weights and transitions to labelled runs of words."""
    segments = sorted((lang, words) for lang, words in segments if words)
    if not segments:
        return None
    labels = sorted({lang for lang, _ in segments})
    frequent = {x: Counter() for x in labels}
    for lang, words in segments:
        frequent[lang].update(words)
    lexicon = frozenset(w for c in frequent.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: how.lexicon_words])
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in segments for w in words}))}
    lists = [word_features(w, lexicon, how.hash_bits) for w in vocabulary]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    at = np.cumsum(sizes) - sizes

    order = np.random.default_rng(how.seed).permutation(len(segments))
    width = how.segment_words * how.runs_in_sequence
    n_seq = -(-len(order) // how.runs_in_sequence)
    x, y = np.zeros((n_seq, width), np.int64), np.full((n_seq, width), -1)
    for s in range(n_seq):
        t = 0
        for i in order[s * how.runs_in_sequence : (s + 1) * how.runs_in_sequence]:
            lang, words = segments[i]
            x[s, t : t + len(words)] = [vocabulary[w] for w in words]
            y[s, t : t + len(words)] = labels.index(lang)
            t += len(words)
    keep = [t for t in range(width) if (y[:, t] >= 0).any()]
    k, n_words = len(labels), int((y >= 0).sum())
    weights, transitions = np.zeros((1 << how.hash_bits, k)), np.zeros((k, k))
    first = [np.zeros_like(weights), np.zeros_like(transitions)]
    second = [np.zeros_like(weights), np.zeros_like(transitions)]
    one_hot = np.eye(k)
    for step in range(1, how.steps + 1):
        e = np.add.reduceat(weights[flat], at, axis=0)[x]
        alpha, beta = np.zeros((len(keep), n_seq, k)), np.zeros((len(keep), n_seq, k))
        for t in range(len(keep)):
            on = (y[:, t] >= 0)[:, None]
            if t == 0:
                alpha[t] = e[:, 0]
            else:
                alpha[t] = np.where(on, e[:, t] + _log_sum(alpha[t - 1][:, :, None] + transitions, 1), alpha[t - 1])
        for t in range(len(keep) - 2, -1, -1):
            on = (y[:, t + 1] >= 0)[:, None]
            beta[t] = np.where(on, _log_sum(transitions[None] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        total = _log_sum(alpha[-1], 1)
        per_word, grad_t = np.zeros((len(vocabulary), k)), np.zeros((k, k))
        for t in range(len(keep)):
            on = np.flatnonzero(y[:, t] >= 0)
            p = np.exp(alpha[t][on] + beta[t][on] - total[on, None])
            gap = one_hot[y[on, t]] - p
            for j in range(k):
                per_word[:, j] += np.bincount(x[on, t], gap[:, j], len(vocabulary))
            if t:
                pair = alpha[t - 1][on][:, :, None] + transitions + (e[on, t] + beta[t][on])[:, None, :] - total[on, None, None]
                grad_t -= np.exp(pair).sum(axis=0)
                np.add.at(grad_t, (y[on, t - 1], y[on, t]), 1.0)
        spread = np.repeat(per_word, sizes, axis=0)
        grad_w = np.stack([np.bincount(flat, spread[:, j], len(weights)) for j in range(k)], axis=1)
        for i, (value, grad) in enumerate(((weights, grad_w), (transitions, grad_t))):
            g = grad / n_words - how.decay * value
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            value += how.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Tagger(labels, lexicon, weights, transitions, how)


def _fitted(training: DataFrame, how: LanguageModel):
    """A function that gives a worker its tagger, or None where nothing was learned from doc_id, text, lang."""
    segments = [(r["lang"], list(r["words"])) for r in training_segments(training, how).collect()]
    tagger = fit_tagger(segments, how)
    parts = (tagger.labels, tagger.lexicon, tagger.weights, tagger.transitions) if tagger is not None else None
    shared = training.sparkSession.sparkContext.broadcast(parts)  # of a fixed size
    key = ("languages", zlib.crc32(repr((segments, how)).encode("utf-8", "surrogatepass")))
    return lambda: None if shared.value is None else worker_memo(key, lambda: Tagger(*shared.value, how))


def identify_languages(docs: DataFrame, training: DataFrame, how: LanguageModel = LanguageModel()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of doc_id, text, learned from doc_id, text, lang."""
    tagger = _fitted(training, how)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts, found = batch.column(1).to_pylist(), tagger()
            names, scores = ([UNKNOWN] * len(texts), [0.0] * len(texts)) if found is None else found.texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, training: DataFrame, how: LanguageModel = LanguageModel()) -> DataFrame:
    """doc_id and spans for each row of doc_id, text: the runs of words of one language in a text that may switch, each
    with its language (``und`` where nothing was learned), first word, word after the last, and the mean probability of
    its words. Words count from 0 in `language_words`. A text without words has no spans."""
    tagger = _fitted(training, how)
    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            lists, found = [language_words(t) for t in batch.column(1).to_pylist()], tagger()
            if found is None:
                spans = [[(UNKNOWN, 0, len(x), 0.0)] if x else [] for x in lists]
            else:
                spans = [language_runs(p, found.labels) for p in found.words(lists)]
            rows = [[dict(zip(("lang", "start", "end", "score"), x)) for x in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<lang:string,start:int,end:int,score:double>>")


def language_runs(probabilities: np.ndarray, labels: list[str]) -> list[tuple[str, int, int, float]]:
    """Runs of words whose likeliest label is the same: the label, start, end (exclusive) and mean probability."""
    if not len(probabilities):
        return []
    best, top = probabilities.argmax(axis=1), probabilities.max(axis=1)
    start = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    end = np.append(start[1:], len(best))
    return [(labels[best[a]], int(a), int(b), float(min(1.0, top[a:b].mean()))) for a, b in zip(start, end)]


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs, docs)
