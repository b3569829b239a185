"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries, for
each end, the best score and the number of tokens on the best path. Rules of the public unigram tokenizers, which fix
ties: scores are added left to right in double precision; at one end, starts are tried from left to right and only a
strictly better score replaces what is held, so of equal paths the longest last piece stays; a character that is no
piece is an unknown of the lowest score less ``UNKNOWN_PENALTY``; a run of unknowns, which the unknown piece itself
belongs to, counts by its UTF-8 bytes if the vocabulary has byte pieces and else once.

Before that, as their word-start step does, spaces become ``▁``, one is put first where there is none, and the text is
cut before each. Pieces of text that recur are counted once per worker.

Vocabulary: the pieces of a sentencepiece file; a piece's score is minus the logarithm of one plus its rank, as in
Zipf's law, because the file's own scores are merge ranks. No tokenizer is trained.

Cases: null and empty texts have 0 tokens. Very long texts without a space take time in proportion to their length and
to the longest piece. Repeated rows are counted each on its own, an empty table gives none. Other columns are kept, whatever
their names; n_tokens is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Memo, hidden, read_table, text_chunks, worker_memo

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """piece and score of each id of a sentencepiece file; None: the public 32k file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 1.0)) for i in range(model.get_piece_size())]


class UnigramCounter(Memo):
    """text between spaces, with its leading ``▁`` -> number of tokens."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_piece: str = "<unk>"):
        super().__init__()
        self.unknown_piece = unknown_piece
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.by_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def compute(self, word: str) -> int:
        return self.viterbi(word)

    def viterbi(self, word: str) -> int:
        n, unknown, lone = len(word), self.unknown, self.unknown_piece
        score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        runs: dict[int, tuple[int, int]] = {}  # end of a path in a run of unknowns -> tokens before it, its bytes
        at = single = 0

        def extend(p: int, start: int, text: str, whole: bool) -> None:
            before, size = runs.get(start, (count[start], 0))
            size += len(text.encode("utf-8", "surrogatepass"))
            runs[p], count[p] = (before, size), before + (1 if not self.by_bytes or whole and start not in runs else size)

        def settle(upto: int) -> None:
            for p in range(max(at, 1), upto):
                if p > single or p != at:
                    total = unknown + score[p - 1]
                    if total > score[p]:
                        score[p] = total
                        extend(p, p - 1, word[p - 1], False)

        for end, (length, gain) in self.automaton.iter(word):  # ends in order, at one end the longest piece first
            end += 1
            if end != at:
                if single != at or end != at + 1:
                    settle(end)
                at = end
            if length == 1:
                single = end
            total = gain + score[end - length]
            if total > score[end]:
                score[end] = total
                if word[end - length : end] == lone:
                    extend(end, end - length, lone, True)
                else:
                    count[end] = count[end - length] + 1
                    if runs:
                        runs.pop(end, None)
        if single != at or n != at:
            settle(n + 1)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if text[0] in (" ", SPACE):
            words = words[1:]
        return sum(map(self.of_word, words))

    def of_word(self, word: str) -> int:
        return self[SPACE + word]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """Adds n_tokens."""
    docs, own = hidden(docs.drop("n_tokens"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the tokenizer, whatever the input
    key = ("unigram", zlib.crc32(repr(vocabulary).encode()))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in text_chunks(batches, at):
            if counter is None:
                counter = worker_memo(key, lambda: UnigramCounter(shared.value))
            counts = [counter.count(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])).select(*own, "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, zipf_vocabulary()).select("doc_id", "n_tokens")
