"""What the operators share: scratch tables in the cluster's shared folder, words, and window hashes."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java, Python and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker holds as words at once; one longer text is held alone.
CHUNK_BYTES = 2_000_000
#: Entries of a per-worker memo before it is emptied.
MEMO_ENTRIES = 400_000


# --- scratch tables -------------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/claimforge-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Where all tables and files of this application stand. Those that a lazy result reads stay there until the
    application's owner removes the folder."""
    return f"{shared_folder(spark)}/claimforge/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; each call gives another one."""
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Arrow batches between Spark and Python workers, in rows and bytes: texts are long, and both sides hold a batch whole.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 2_000), "spark.sql.execution.arrow.maxBytesPerBatch": (1 << 28, 8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches where the session still has Spark's own or a larger one."""
    for key, (usual, small) in BATCH.items():
        try:
            now = int(spark.conf.get(key, str(usual)))
        except ValueError:
            now = usual
        if now <= 0 or now > small:
            spark.conf.set(key, str(small))


class Scratch:
    """Writes intermediate tables to the shared folder, and removes those that are no longer read.

    A written table cuts the lineage: a lost executor costs no more than the tasks it ran. While a table is being
    written, Spark is asked to drop the shuffle files of the finished action, since nothing reads them again.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}
        small_batches(spark)

    @contextlib.contextmanager
    def cleaning(self):
        """Asks Spark to drop the shuffle files of each action run inside, once it has ended."""
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        with self.cleaning():
            df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a last table and removes all others."""
        out = self.write(name, df)
        self.drop(*(n for n in self.paths if n != name))
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hidden(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """The documents with the columns in ``read`` under their names and all others under new ones that no operator uses,
    and the columns that give them back as they were."""
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in read}
    plain = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    inner = docs.select(*[plain[c].alias(own[c]) if c in own else plain[c] for c in docs.columns])
    return inner, [F.col(own[c]).alias(c) if c in own else plain[c] for c in docs.columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- native word functions ------------------------------------------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def native_words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def native_word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; such rows are never learned from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


# --- words and hashes in Python workers -----------------------------------------------------------------------------

_UPPER = bytes(range(65, 91))
LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
#: Lower-cases A-Z and turns every byte outside [0-9A-Za-z\x80-\xff] into a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Memo(dict):
    """A memo of bounded size in two generations: when it is full, it becomes the old one, and what is asked for again
    moves back. Values come from ``compute``. Workers are reused, so a memo made by ``worker_memo`` outlives a task."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.old: dict = {}
        self.entries = entries

    def compute(self, key):
        raise NotImplementedError

    def keep(self, key, value) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, values: dict) -> None:
        if len(self) + len(values) > self.entries:
            self.old = dict(self)
            self.clear()
        self.update(values)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) < 100:
            self.keep(key, value)
        return value


_memos: dict = {}


def worker_memo(key: tuple, make):
    """A Python worker's memo; ``make`` makes it. A worker holds one memo, that of the operator it served last."""
    if key not in _memos:
        _memos.clear()
        _memos[key] = make()
    return _memos[key]


def encode(text: str) -> bytes:
    """UTF-8 bytes of a text."""
    return text.encode("utf-8", "surrogatepass")


def text_chunks(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into pieces of about ``limit`` text bytes, so that no piece holds many long texts at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of the input."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n >= 1 consecutive entries. Runs are put together from runs of 1, 2, 4, ... entries, each
    pair mixed as a whole, so what two runs have in common doesn't cancel out. Time grows with the logarithm of n."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, k = None, 0, words, 1
    while True:
        if n & k:
            out = power[:count] if out is None else mix(out * _BASE + power[done : done + count])
            done += k
        if 2 * k > n:
            return out
        power = mix(power[:-k] * _BASE + power[k:])
        k *= 2


_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[list(SPACES.encode())] = True
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Runs that are hashed at once, and bytes beyond which a run is hashed by xxhash.
HASH_RUNS, LONG_RUN = 1 << 14, 256


def segment_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes from ``first`` on; runs aren't empty. Eight bytes at a time are added to
    what came before and mixed, so runs of up to eight bytes and one length never have the same hash."""
    lanes = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    out = np.empty(len(first), np.uint64)
    for a in range(0, len(first), HASH_RUNS):
        at, left = first[a : a + HASH_RUNS], size[a : a + HASH_RUNS]
        h = mix(mix(left.astype(np.uint64)) + (lanes[at] & _FIRST_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left <= LONG_RUN))
        at, left = at[more] + 8, left[more] - 8
        while len(more):
            h[more] = mix(h[more] + (lanes[at] & _FIRST_BYTES[np.minimum(left, 8)]))
            go = left > 8
            more, at, left = more[go], at[go] + 8, left[go] - 8
        out[a : a + HASH_RUNS] = h
    for k in np.flatnonzero(size > LONG_RUN):
        out[k] = xxhash.xxh3_64_intdigest(raw[first[k] : first[k] + size[k]])
    return out


def cut_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of several texts in a row, a space after each; where each word (cut at ASCII white space) starts and its
    bytes; the number of each text's first word, and its word count."""
    parts = [encode(t) if t else b"" for t in texts]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    raw = b" ".join([*parts, b""])
    raw = np.frombuffer(raw.translate(LOWER_TABLE) if lower else raw, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE_BYTE[raw], prepend=True, append=True))
    first, size = edges[::2], edges[1::2] - edges[::2]
    counts = np.bincount(np.searchsorted(ends, first, "right"), minlength=len(texts)).astype(np.int64)
    return raw, first, size, np.cumsum(counts) - counts, counts


def hashed_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of several texts in a row, the number of each text's first word, and its word count.
    Memory beyond the result is a few bytes for each byte of text, and a bounded block."""
    raw, first, size, starts, counts = cut_words(texts, lower)
    return segment_hashes(raw, first, size), starts, counts


LETTER = re.compile(r"[^\W\d_]")
