"""Token ids as fixed-width bit-packed files.

Each id takes the least number of bits that holds the largest id. A file holds blocks of ``block_ids`` ids, each block
starting on a byte, then a footer: the documents' ids and starts, the blocks' byte offsets, sizes, and a closing magic.
Any run of ids is read by seeking to its blocks and unpacking them with numpy.

Documents go into files in ascending doc_id order (null first; ties by text), one file for each range partition, so
that the files in order hold all documents in order. Files are written under another name and then renamed, so a task
that runs again replaces its own file by the same bytes.

Tokenizing: a text is cut before each single space that stands between two characters that are no white space, around
each single line break that does, and before a point or comma between a letter and a space or line break. The byte-level
pre-tokenizer always cuts there, and no merge crosses such a cut, so the pieces' ids in a row are the ids of the whole
text; pieces that recur are encoded once per worker, and new ones together, joined by line breaks, which such a
pre-tokenizer keeps apart. A worker looks pieces up by 64-bit hashes and compares their bytes, in a batch and in its memo:
pieces of one hash and other bytes are encoded each on its own. The tests hold this against whole-text encoding.

Cases: null and empty texts give the end id alone. Repeated rows are repeated documents. An empty table gives no files.
A very long text is one chunk of its own, held whole in its task.
Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, scratch_path, segment_hashes, text_chunks, worker_memo

MAGIC = b"CFTOKID1"
FOOTER = struct.Struct("<QQQQQQ8s")  # bits, block_ids, documents, ids, blocks, footer bytes before this, magic
#: Pieces in one generation of a worker's memo, about 50 bytes each.
PIECE_ENTRIES = 1_000_000
#: Bytes of pieces that are compared at once.
COMPARED = 1 << 18
_cut = re.compile(r"(?<=\S)(?= \S)")
_odd_space = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_BESIDE = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
_plain = re.compile(r" ?\S+").fullmatch
_LETTER, _WHITE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WHITE[list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")] = True


def pieces(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, where each piece starts, and how many pieces each text has.

    Texts whose spaces all stand between two characters that are no white space are cut in arrays; others, which are few,
    one by one, at single spaces only.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    odd = np.fromiter((bool(t) and (t[0] == " " or t[-1] == " " or any(x in t for x in _BESIDE) or _odd_space(t) is not None) for t in texts), bool, len(texts))
    joined = b"".join(parts)
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return joined, starts[:0], np.zeros(len(texts), np.int64)
    head = np.zeros(len(raw) + 1, bool)  # the first byte of a text, and the end
    head[starts[sizes > 0]] = head[-1] = True
    white = _WHITE[raw]
    cut = raw == 32
    # What comes before and after each byte of its own text is no white space.
    after = np.append(~white[1:], False) & ~head[1:]
    before = np.append(False, ~white[:-1]) & ~head[:-1]
    line = (raw == 10) & before & after
    stop = ((raw == 46) | (raw == 44)) & np.append(False, _LETTER[raw[:-1]]) & ~head[:-1]
    stop &= np.append((raw[1:] == 32) | (raw[1:] == 10), False) & ~head[1:]
    cut |= line | stop
    cut[1:] |= line[:-1]
    for k in np.flatnonzero(odd):
        cut[starts[k] : starts[k] + sizes[k]] = False
        at = [m.start() for m in _cut.finditer(texts[k])]
        if at:
            ends = np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in map(texts[k].__getitem__, map(slice, [0, *at[:-1]], at))])
            cut[starts[k] + ends] = True
    cut |= head[:-1]
    first = np.flatnonzero(cut)
    return joined, first, np.diff(np.searchsorted(first, np.append(starts, len(raw))))


@dataclass(frozen=True)
class TokenOutput:
    tokenizer: str | None = None  # path of a tokenizers file; None: the public byte-level BPE of 50k
    end_id: int = 0
    block_ids: int = 16_384

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")


class PieceTable:
    """Ids and bytes of pieces by the pieces' hashes, in sorted arrays: about 50 bytes a piece."""

    def __init__(self):
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.first, self.size, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each piece (its hash, and its bytes in ``raw``), or -1; and whether its hash is there."""
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), bool)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[k] == keys
        at = np.flatnonzero(there)
        same = equal_runs(raw, first[at], size[at], self.raw, self.first[k[at]], self.size[k[at]])
        out = np.full(len(keys), -1)
        out[at[same]] = k[at[same]]
        return out, there

    def add(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: np.ndarray) -> None:
        """Adds keys that it lacks; n ids and ``size`` bytes each, in a row."""
        order = np.argsort(np.append(self.keys, keys), kind="stable")
        held = lambda old, new: np.append(old, new)[order]
        self.at, self.first = held(self.at, len(self.ids) + np.cumsum(n) - n), held(self.first, len(self.raw) + np.cumsum(size) - size)
        self.keys, self.n, self.size = held(self.keys, keys), held(self.n, n), held(self.size, size)
        self.ids, self.raw = np.append(self.ids, ids), np.append(self.raw, raw)


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n places each, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def equal_runs(raw: np.ndarray, first: np.ndarray, size: np.ndarray, other: np.ndarray, other_first: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each run of bytes (not empty) of ``raw`` is that of ``other``, some bytes at a time."""
    out, upto = size == other_size, np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + COMPARED, "right")))
        k = np.flatnonzero(out[a:b]) + a
        if len(k):
            n = size[k]
            out[k] = np.logical_and.reduceat(raw[runs(first[k], n)] == other[runs(other_first[k], n)], np.cumsum(n) - n)
        a = b
    return out


class PieceIds:
    """The ids of texts, from a memo of pieces in two generations: when the young one is full, it becomes the old one, and
    what is found there moves back."""

    def __init__(self, path: str, entries: int = PIECE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.entries, self.young, self.old = entries, PieceTable(), PieceTable()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        line = self.tokenizer.encode("a\na\n a", add_special_tokens=False).ids
        # None if this tokenizer has no token of its own for a line break; then pieces are encoded one by one.
        self.line_id = line[1] if len(line) == 5 and line[1] == line[3] != line[0] else None

    def _new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them in a row. Pieces without white space but a leading space go to the
        tokenizer together, one a line."""
        lone = self.line_id is None
        out: list[np.ndarray] = [None] * len(texts)
        together = [] if lone else [k for k, t in enumerate(texts) if _plain(t)]
        for a in range(0, len(together), 1024):
            part = together[a : a + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_id)
            if len(ends) == len(part) - 1:
                for k, x, y in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)]):
                    out[k] = ids[x:y]
        for k, found in enumerate(out):
            if found is None:
                out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4")
        return np.fromiter(map(len, out), np.int64, len(out)), np.concatenate([np.zeros(0, "<u4"), *out])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        joined, first, counts = pieces(texts)
        size, raw = np.diff(np.append(first, len(joined))), np.frombuffer(joined, np.uint8)
        keys, where, inverse = np.unique(segment_hashes(raw, first, size), return_index=True, return_inverse=True)
        lead = where[inverse]
        n_keys, odd = len(keys), {}  # odd: the pieces that have the hash of others, and where each stands first
        for k in np.flatnonzero(~equal_runs(raw, first, size, raw, first[lead], size[lead])).tolist():
            inverse[k] = n_keys + odd.setdefault(joined[first[k] : first[k] + size[k]], (len(odd), k))[0]
        if odd:
            where, keys = np.append(where, [k for _, k in odd.values()]), np.append(keys, np.zeros(len(odd), np.uint64))
        at, own = first[where], size[where]
        (young, had), (old, _) = (t.find(keys, raw, at, own) for t in (self.young, self.old))
        old[young >= 0] = -1
        new = np.flatnonzero((young < 0) & (old < 0))
        spans = zip(at[new].tolist(), (at + own)[new].tolist())
        new_n, new_ids = self._new([joined[a:b].decode("utf-8", "surrogatepass") for a, b in spans])
        # One row of ids for each distinct piece, from three places.
        start, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        base = 0
        for table, found in ((self.young, young), (self.old, old)):
            held = found >= 0
            start[held], n[held] = base + table.at[found[held]], table.n[found[held]]
            base += len(table.ids)
        start[new], n[new] = base + np.cumsum(new_n) - new_n, new_n
        ids = np.concatenate([self.young.ids, self.old.ids, new_ids])
        keep = np.flatnonzero(~had & (own < 100) & (np.arange(len(keys)) < n_keys))
        if len(self.young.keys) + len(keep) > self.entries:
            self.old, self.young = self.young, PieceTable()
            keep = np.flatnonzero((own < 100) & (np.arange(len(keys)) < n_keys))
        self.young.add(keys[keep], n[keep], ids[runs(start[keep], n[keep])], own[keep], raw[runs(at[keep], own[keep])])
        each = n[inverse]
        flat = ids[runs(start[inverse], each)]
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(counts))] * 4
        data = flat.tobytes()
        return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def bits_of(vocabulary: int) -> int:
    """The least number of bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """32-bit ids as ``bits`` bits each, least significant bit first."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    flags = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flags.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
        return wide.view("<u4").reshape(n)
    flags = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class TokenWriter:
    """Writes one file, holding one block of ids and the documents' table in memory."""

    def __init__(self, sink, bits: int, block_ids: int):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = self.written = 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.offsets: list[int] = [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_ids += len(ids) // 4
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= 8 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        full = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for a in range(0, full, self.block_ids):
            data = pack(ids[a : min(a + self.block_ids, full)], self.bits)
            self.sink.write(data)
            self.written += len(data)
            self.offsets.append(self.written)
        self.waiting, self.n_waiting = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8).tobytes()
        table = b"".join(
            [
                np.array([d or 0 for d in self.docs], "<i8").tobytes(), null,
                np.array([*self.starts, self.n_ids], "<i8").tobytes(), np.array(self.offsets, "<i8").tobytes(),
            ]
        )
        self.sink.write(table)
        self.sink.write(
            FOOTER.pack(self.bits, self.block_ids, len(self.docs), self.n_ids, len(self.offsets) - 1, len(table), MAGIC)
        )


class TokenReader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        self.bits, self.block_ids, n_docs, self.n_ids, n_blocks, table, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - FOOTER.size - table)
        raw = source.read(table)
        ids = np.frombuffer(raw, "<i8", n_docs)
        null = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.docs = [None if x else int(d) for d, x in zip(ids, null)]
        self.starts = np.frombuffer(raw, "<i8", n_docs + 1, 9 * n_docs)
        self.offsets = np.frombuffer(raw, "<i8", n_blocks + 1, 9 * n_docs + 8 * (n_docs + 1))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start (inclusive) to stop (exclusive)."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            out.append(unpack(raw[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], n, self.bits))
        return np.concatenate(out)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start and ids of each document, reading some blocks at a time."""
        at, upto, held = 0, 0, np.zeros(0, "<u4")
        for k, doc in enumerate(self.docs):
            a, b = int(self.starts[k]), int(self.starts[k + 1])
            if b > upto:
                more = min(self.n_ids, max(b, upto + 16 * self.block_ids))
                held = np.concatenate([held[a - at :], self.read(upto, more)])
                at, upto = a, more
            yield doc, a, held[a - at : b - at]


def write_token_files(docs: DataFrame, folder: str, how: TokenOutput = TokenOutput()) -> list[dict]:
    """Writes all documents to files under ``folder`` and returns, in order, path, documents and ids of each file."""
    spark = docs.sparkSession
    path = how.path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top)
        own = f"{top}/.part-{part:06d}-{TaskContext.get().taskAttemptId()}"
        pieces = writer = None
        with store.open_output_stream(own) as sink:
            for batch in text_chunks(batches, limit=4_000_000):
                if writer is None:
                    pieces = worker_memo(("pieces", path), lambda: PieceIds(path))
                    writer = TokenWriter(sink, bits_of(pieces.tokenizer.get_vocab_size()), how.block_ids)
                end = np.array([how.end_id], "<u4").tobytes()
                for doc, ids in zip(batch.column(0).to_pylist(), pieces.encode_all(batch.column(1).to_pylist())):
                    writer.add(doc, ids + end)
            if writer:
                writer.close()
        if not writer:
            store.delete_file(own)
            return
        store.move(own, f"{top}/part-{part:06d}.tok")
        row = {"part": [part], "path": [f"{folder}/part-{part:06d}.tok"], "docs": [len(writer.docs)], "ids": [writer.n_ids]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with Scratch(spark, "tokens").cleaning():
        rows = ordered.mapInArrow(run, "part int, path string, docs long, ids long").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.part)]


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start (over all files), n_tokens and crc32 of the ids of each document, one task for each file."""
    start, rows = 0, []
    for f in files:
        rows.append((f["path"], start))
        start += f["ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    found = [(d, base + a, len(ids), zlib.crc32(ids.tobytes())) for d, a, ids in TokenReader(source).documents()]
                columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    files = write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, files)
